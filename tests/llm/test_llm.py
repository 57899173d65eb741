"""Corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from amountlake.llm import ann, chat, common, decontam, kn_quality, langid, mixing, simhash, similar, substring_dedup, suffix_dedup, tokenbin
from amountlake.llm.common import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, stock=400):
    return [f"w{rng.randrange(stock)}x" for _ in range(n)]


def frame(spark, rows):
    """Documents with clashing extra columns."""
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in ("size", "key", "g", "h", "fp", "_k", "_t", "score", "n", "target", "copies", "p", "ids"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 120))), "en", f"s{i % 4}") for i in range(60)]
    shared, short = " ".join(words(rng, 70)), " ".join(words(rng, 24))
    for i in (60, 61, 62, 63):
        rows.append((i, " ".join(words(rng, 30)) + f" {shared}  " + " ".join(words(rng, 10 * (i - 59))), "en", None))
    rows += [(70 + i, " ".join(words(rng, 20)) + "\n" + short + "\t" + " ".join(words(rng, 20)), "en", "s1") for i in range(3)]
    rows += [(80, None, None, None), (81, "", "en", "s9"), (82, " \n\t ", "en", "s1"), (None, "a b c", "en", "s1"), (83, "one", "en", "s0"), (84, "one two", "en", "s0"), (90, rows[5][1], "en", "s2"), (91, rows[5][1].upper(), "fr", "s2")]
    rows += [(92, rows[7][1], "en", "s0")] * 2 + [(93, " ".join(words(rng, 40_000)) + " " + shared, "en", "s0")]
    return frame(spark, rows)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_substring_dedup(spark, docs):
    data = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = {}, []
    for n, (i, text) in enumerate(data):
        w = WORD.findall(text or "")
        again = n and data[n - 1] == (i, text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if seen.setdefault(k, (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append(want[-1] if again else (i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r)[:5] for r in substring_dedup.dedup(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[2] for r in got) > 200
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_one_id_for_two_texts(spark):
    rng = random.Random(9)
    text = " ".join(words(rng, 50))
    df = frame(spark, [(1, text, None, None), (1, text + " more", None, None), (1, text, None, None)])
    assert sorted(r.n_removed for r in substring_dedup.dedup(df).collect()) in ([0, 0, 50], [0, 50, 50])


def brute_repeats(rows, window=50):
    """{(id, text): (words in repeated windows, words in late ones)} of distinct documents."""
    order = lambda r: (r[0] is None, r[0] or 0)
    where, every, late = {}, {}, {}
    for i, text in sorted(set(rows), key=order):
        w = WORD.findall(text or "")
        for s in range(len(w) - window + 1):
            where.setdefault(tuple(w[s : s + window]), []).append((i, text, s))
    for places in where.values():
        for n, (i, text, s) in enumerate(places):
            if len(places) > 1:
                every.setdefault((i, text), set()).update(range(s, s + window))
            if n:
                late.setdefault((i, text), set()).update(range(s, s + window))
    return {r: (words, late.get(r, set())) for r, words in every.items()}


def covered(spans):
    return {x for s in spans for x in range(s["from"], s["to"])}


def check_repeats(df):
    want = sorted(((str(i), w, late) for (i, _), (w, late) in brute_repeats(rows_of(df)).items()), key=lambda r: (r[0], sorted(r[1])))
    got = suffix_dedup.repeats(df).collect()
    assert sorted(((str(r.doc_id), covered(r.spans), covered(r.late)) for r in got), key=lambda r: (r[0], sorted(r[1]))) == want
    assert all(r.n_repeated == len(covered(r.spans)) and r.n_late == len(covered(r.late)) for r in got)
    return {r.doc_id: r for r in got}


def test_suffix_dedup(spark, docs):
    found = check_repeats(docs)
    assert {60, 61, 62, 63, 93} <= set(found) and not {70, 71, 72} & set(found)
    assert found[61].spans[0]["to"] - found[61].spans[0]["from"] == 70 and found[60].n_late == 0 and found[63].n_late == 70
    assert set(found[60].others) & {61, 62, 63, 93}
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shuffle", [1, 16])
def test_suffix_runs(spark, shuffle):
    """A passage of 60 words in forty differing contexts, repeats in one document, part matches and ranges that end in a run."""
    rng = random.Random(4)
    new = lambda n: " ".join(words(rng, n, 10_000))
    shared, own = new(60), new(55)
    part = shared.split()
    rows = [(i, f"{new(20 + i)} {shared} {new(70)}", None, None) for i in range(40)]
    rows += [(50, f"{own} {new(9)} {own}", None, None), (51, f"{' '.join(part[5:])} {new(30)} {' '.join(part[:50])}", None, None), (52, f"{new(80)} {' '.join(part[:49])} {new(5)}", None, None)]
    rows += [(53, " ".join(["again"] * 300), None, None), (None, shared, None, None), (54, shared, None, None), (54, shared, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
    try:
        found = check_repeats(frame(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(found[i].n_late >= 60 for i in range(40)) == 39 and found[0].n_late == 0 and found[50].n_late == 55 and 52 not in found


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(spark, docs):
    data = rows_of(docs)
    fps = {r: brute_fingerprint(r[1]) for r in data}
    root = brute_components(set(fps.values()))
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted((str(i), fps[i, t], least.get(root[fps[i, t]])) for i, t in data)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([*least.values(), None], key=str) and 90 not in kept and 92 not in kept
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 40, 256])
def test_simhash_links(spark, hot):
    """Random neighbours, and posting lists of 80 and more that share seven and five bytes."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for d in range(5):
            x = f
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    fps |= {(0xABCDEF12 << 32) | rng.getrandbits(8) for _ in range(80)}
    fps |= {(0xFFCDEF1234 << 24) | rng.getrandbits(24) & 0x0F0F0F for _ in range(150)}
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df, hot=hot).collect()}
    assert got == want and len(want) > 100
    edges = spark.createDataFrame([(signed(a), signed(b)) for a, b in want], "a long, b long")
    root = brute_components({signed(f) % (1 << 64) for p in want for f in p})
    grouped = {}
    for r in simhash.components(edges).collect():
        grouped.setdefault(r.root, set()).add(r.node % (1 << 64))
    grouped = sorted(sorted(v | {k % (1 << 64)}) for k, v in grouped.items())
    wanted = {}
    for f, r in root.items():
        wanted.setdefault(r, set()).add(f)
    assert grouped == sorted(sorted(v) for v in wanted.values())


def test_simhash_list_of_many(spark):
    """Twenty thousand fingerprints that share five bytes make short lists, and their links are found."""
    n = 20_000
    fps = spark.range(n).select((F.lit(0x1122334455 << 24).cast("long") + F.pmod(F.xxhash64("id"), F.lit(1 << 24))).alias("fp")).distinct()
    posts = simhash._again(simhash._again(fps.select("fp", F.lit(simhash._mask(simhash._bytes((0, 1, 2)))).alias("mask")), simhash._NEXT), simhash._LAST)
    assert posts.groupBy("mask", "key").count().agg(F.max("count")).first()[0] <= 4096
    have = {r.fp & 0xFFFFFF for r in fps.collect()}
    near = {sum(1 << b for b in c) for d in (1, 2, 3) for c in combinations(range(24), d)}
    own = [x for x in have if x % 512 == 7]
    want = sum((x ^ d) in have for x in own for d in near)
    found = simhash.links(fps)
    low = lambda c: F.pmod(F.col(c), F.lit(512)) == 7
    assert found.agg(F.sum(low("a").cast("int") + low("b").cast("int"))).first()[0] == want > 1000


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    sizes = {s: n for s, _, n in by}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, capped = {}, set()
    while True:  # reshare until none is above
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        goal = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for (s, target, n), rows in by.items():
        assert target == pytest.approx(goal[s]) and n == sum(r.size for r in rows)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
        if target >= n:
            assert all(r.copies >= int(target // n) for r in rows if r.size)
    for per_slice in (1, 5):
        again = mixing.mix(docs.repartition(7), per_slice=per_slice).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    empty = frame(spark, [(1, None, None, None), (2, "", "x", None)])
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(docs.limit(0)).count() == 0
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)


def test_quality_weighs(spark):
    """Good documents are taken more often than junk ones of the same size."""
    df = frame(spark, [(i, ("good text " if i % 2 else "%%% ### ") * 20, None, f"s{i % 3}") for i in range(900)])
    rows = mixing.mix(df).filter("target < source_size").collect()
    good, junk = (sum(r.copies for r in rows if r.doc_id % 2 == p) for p in (1, 0))
    assert good > 1.5 * junk > 0


def test_language(spark):
    rng = random.Random(3)
    stock = {"en": "the and ing tion ea th", "de": "sch der ung ein keit ü", "es": "ción que os ñ llo el"}
    rows = [(i, " ".join("".join(rng.choices(stock[x].split(), k=2)) for _ in range(30)), x, None) for i, x in enumerate(list(stock) * 150)]
    rows += [(1000, None, "en", None), (1001, "", "en", None), (1002, "123 !!", "en", None), (1003, rows[0][1], None, None), (None, rows[1][1], "de", None), (1004, rows[0][1] * 3000, "en", None)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [i for i in range(450) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(450))
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98 and len(held) > 80
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und"] * 3 + ["en", "en", "de"] and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}
    assert langid.identify(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 20, 60])
def test_codewords(n):
    code = langid.codewords(n)
    gap = (code.shape[1] - code @ code.T) // 2
    assert set(np.unique(code)) == {-1, 1} and gap[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2 if n < 8 else 8)


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ODD = ["It's  a DON'T 12 34% ¡Qué! l'été", "naïve x\x85y", "İstanbul Σας", "a\x1cb", "<|endoftext|> a<|startoftext|>b", "é é 数字 🙂", "''' 's 't'x 're", "½ ²x ªº", "tab\tnew\nline\r\n", "İı ß ẞ", "x" * 3000, "_a_b-c.d", "﻿BOM", " sep"]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path()), tokenbin.Encoder(path(), memory=50)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdé'’ßñ .,!?12_- \n%&ÄÖ") for _ in range(80)) for _ in range(300)]
    assert own.known
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_keeps_every_character():
    own = tokenbin.Encoder(path())
    assert own.known
    for c in map(chr, range(0x250)):
        texts = [c, f"a{c}b", f"hello {c}{c}", f"{c}li gedir", f"AB{c}CD 1{c}2", f"!{c}'s {c}'"]
        for text, got in zip(texts, own.encode(texts)):
            assert got == own.whole(text), repr(text)


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path())
    rows = [(500 + i, t, None, None) for i, t in enumerate(ODD)]
    df = docs.unionByName(frame(spark, rows)).repartition(5)
    got = {}
    for r in tokenbin.tokenize(df, path(), f"file://{tmp_path}/ids").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    start = 0
    data = sorted(rows_of(df), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in data:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, len(ids), zlib.crc32(ids.tobytes())) in got[i]
        start += len(ids)
    assert sum(map(len, got.values())) == len(data)
    shards = sorted(p.stem for p in (tmp_path / "ids").glob("*.idx"))
    one = tokenbin.Shard(f"{tmp_path}/ids", int(shards[0]))
    assert one.frames(0, 1)[0][-1] == 2 and (np.diff(one.doc_id[~one.null]) >= 0).all()
    (tmp_path / "ids/dictionary").write_bytes(b"other")
    with pytest.raises(ValueError):
        tokenbin.Shard(f"{tmp_path}/ids", int(shards[0]))
    assert tokenbin.tokenize(docs.limit(0), path()).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(1, line(20)), (2, line(60)), (3, None), (4, ""), (5, "Too short!"), (6, line(14)), (6, line(14)), (7, "x"), (None, "6 by 7")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))

    def edited(text, n):
        for _ in range(n):
            i = rng.randrange(len(text))
            text = rng.choice((text[:i] + text[i + 1 :], text[:i] + "z" + text[i:], text[:i] + "q" + text[i + 1 :]))
        return text

    rows = [(i, line(80), None, None) for i in range(40)]
    rows += [(100, line(30) + " " + items[0][1] + " " + line(9), None, None), (101, items[0][1].upper().replace(" ", "\n"), None, None), (102, line(5) + " " + edited(items[0][1], 5) + " xy", None, None)]
    rows += [(103, line(900) + items[1][1][:200] + line(3), None, None), (104, edited(items[5][1], 2), None, None), (105, edited(items[0][1], 40), None, None), (106, None, None, None), (107, "", None, None), (108, "it is\ttoo, SHORT.", None, None), (109, "x too short 6 by 7", None, None), (110, "too shorty xx 16 by 7", None, None), (None, items[0][1], None, None), (0, items[0][1], None, None)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {0, 100, 101, 102, 103, 104, 108, 109, None} and got[100].item_ids == [1] and got[103].item_ids == [2] and got[100].least_edits == 0 and 0 < got[102].least_edits <= 6
    assert got[108].item_ids == [5] and got[109].item_ids == [5, 7, None]
    by_block = {r.doc_id: r.item_ids for r in decontam.contaminated(df, bench, block=1).collect()}
    assert by_block == {i: r.item_ids for i, r in got.items()}
    for block in (1, 4 << 20):  # rows are judged by their own text: without an id, or beside a row of the same id
        kept = decontam.clean(df, bench, block=block)
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows[:-1] if r[0] not in {100, 101, 102, 103, 104, 108, 109, None}) and kept.columns == df.columns
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_alignment_against_full_table():
    """Every pattern within its edit budget of some part of a text is found, with its distance."""
    import pyarrow as pa

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    patterns = decontam.Patterns([(i, text(70 + 10 * i)) for i in range(4)], 0.05, 120, 60)
    for _ in range(40):
        which = rng.randrange(4)
        p = patterns.text[which].tobytes().decode()
        for _ in range(rng.randrange(0, patterns.edits[which] + 1)):
            i = rng.randrange(len(p))
            p = rng.choice((p[:i] + p[i + 1 :], p[:i] + "e" + p[i:], p[:i] + "a" + p[i + 1 :]))
        data, at = decontam.fold(pa.array([text(rng.randrange(50)), text(rng.randrange(99)) + p + text(rng.randrange(99))]))
        full = np.zeros(len(data) - at[1] + 1)
        for ch in patterns.text[which]:
            new = np.empty_like(full)
            new[0] = full[0] + 1
            for j in range(1, len(full)):
                new[j] = min(full[j] + 1, new[j - 1] + 1, full[j - 1] + (data[at[1] + j - 1] != ch))
            full = new
        doc, found, cell = patterns.candidates(data, at)
        cost, _ = patterns.verify(data, at, doc, found, cell)
        assert min(cost[(doc == 1) & (found == which)]) == full.min() <= patterns.edits[which]


def kneser_ney(texts, order):
    """The textbook recursion over dictionaries of word tuples: log probability of a word after a context."""
    toks = [["<s>"] * (order - 1) + WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or "")) for t in texts]
    levels = {order: {}}
    for t in toks:
        for i in range(order - 1, len(t)):
            g = tuple(t[i - order + 1 : i + 1])
            levels[order][g] = levels[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    off, mates = {}, {n: {} for n in levels}
    for n, c in levels.items():
        r = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = r[0] / (r[0] + 2 * r[1]) if r[0] + r[1] else 0.5
        d = [i - (i + 1) * y * r[i] / r[i - 1] if r[i - 1] else 0.5 * i for i in (1, 2, 3)]
        off[n] = [0, *(min(max(x, 0.05), i - 0.05 if i < 3 else 2.95) for x, i in zip(d, (1, 2, 3)))]
        for g, v in c.items():
            mates[n].setdefault(g[:-1], []).append(v)

    def p(g):
        n, own = len(g), levels[len(g)].get(g, 0)
        seen = mates[n].get(g[:-1])
        lower = p(g[1:]) if n > 1 else 1 / (len(levels[1]) + 1)
        if not seen:
            return lower
        return (own - off[n][min(own, 3)]) / sum(seen) + sum(off[n][min(v, 3)] for v in seen) / sum(seen) * lower

    def perplexity(text):
        t = ["<s>"] * (order - 1) + WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        logs = [np.log(p(tuple(t[i - order + 1 : i + 1]))) for i in range(order - 1, len(t))]
        return float(np.exp(-np.mean(logs))) if logs else None

    return perplexity


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_against_dictionaries(spark, order):
    """Perplexities from count joins are the textbook's, whatever the shards, passes and batches."""
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("aa a b c The the X é".split()) for _ in range(rng.randrange(0, 40)))
    texts = [text() for _ in range(60)]
    want = kneser_ney(texts[:30], order)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "never seen these", None, " ", "a"])], "id int, text string").withColumn("_block", F.lit("x"))
    for bits, passes in ((1, 1), (5, 3)):
        model = kn_quality.fit(df.filter("id < 30").repartition(3).select("text"), order, bits)
        got = kn_quality.perplexities(df.repartition(4), model, ["id", "text"], passes).collect()
        assert len(got) == 64
        for r in got:
            assert r.perplexity == (None if want(r.text) is None else pytest.approx(want(r.text), rel=1e-9))


def test_kneser_ney(spark):
    rng = random.Random(7)
    stock = [f"word{i}" for i in range(40)]
    def good():  # each word has three followers
        at, out = rng.randrange(40), []
        for _ in range(80):
            out.append(stock[at])
            at = (at * 7 + rng.randrange(3)) % 40
        return " ".join(out)

    rows = [(i, good(), ("en", "fr")[i % 2], None) for i in range(400)]
    shuffled = [" ".join(rng.sample(r[1].split(), 80)) for r in rows[:20]]
    rows += [(400 + i, t, "en", None) for i, t in enumerate(shuffled)]
    rows += [(500, None, "en", None), (501, "", None, None), (502, good(), None, None), (None, good(), "en", None), (503, " ".join([good()] * 300), "en", None), (7, rows[7][1], "fr", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300)] + [(0, 1, 0), (None, 1, 0), (410, 0, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    found = kn_quality.classify(df, labels, least=20, quantile=0.9).collect()
    got = {r.doc_id: r for r in found}
    # the whole of it again: model, thresholds and decisions
    h = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("h")).collect()}
    trusted = [r for r in rows if r[0] is not None and r[0] < 300 and r[1] is not None]
    want = kneser_ney([r[1] for r in trusted if h[r[0]]], 2)
    edge = {}
    for lang in ("en", "fr", None):
        own = sorted(want(r[1]) for r in trusted if not h[r[0]] and lang in (None, r[2]))
        edge[lang] = own[int(np.ceil(0.9 * len(own))) - 1]
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, lang, _ in rows if i == r.doc_id and lang == r.lang)
        assert r.threshold == pytest.approx(edge[r.lang], rel=1e-9)
        if text:
            assert r.perplexity == pytest.approx(want(text), rel=1e-6) and r.keep == (r.perplexity <= r.threshold)
        else:
            assert (r.perplexity, r.keep, r.n_words) == (None, False, 0)
    assert not any(got[400 + i].keep for i in range(20)) and sum(got[i].keep for i in range(400)) > 300  # word order counts
    assert sum(r.perplexity == r.threshold and r.keep for r in found) >= 2  # ties stay
    assert all(r.keep for r in kn_quality.classify(df, labels.limit(0)).collect() if r.n_words)
    assert kn_quality.classify(df.limit(0), labels).count() == 0


def test_chat(spark):
    rng = random.Random(10)
    rows = []
    for c in range(100):
        for t in range(rng.randrange(1, 9)):
            text = "\n".join(" ".join(words(rng, rng.randrange(1, 12))) for _ in range(rng.randrange(1, 4)))
            rows.append((c, t, ("user", "assistant")[t % 2] if t or c % 5 else "system", text))
    rows += [(100, 0, None, None), (100, 1, "assistant", ""), (101, None, "user", "hi"), (None, 0, "user", "hello"), (102, 0, "user", "x " * 50_000), (103, 0, "user", "a"), (103, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("states", F.lit(1)).withColumn("part", F.lit(1))
    raw = chat.transcripts(table).cache()
    known = raw.filter("conv_id < 100").filter(~chat.held_out(F.col("conv_id")))
    model = chat.fit(known)
    run = lambda raw, model: chat.format_transcripts(raw, model, ["conv_id", "part", "roles"]).cache()
    right = lambda got: sum(r.n_right for r in got if r.held_out and r.conv_id < 100) / sum(r.n_turns for r in got if r.held_out and r.conv_id < 100)
    formatted = run(raw, model)
    got = chat.digest(formatted).collect()
    nothing = chat.digest(run(raw, chat.fit(raw.limit(0)))).collect()
    assert right(got) > 0.85 > right(nothing) + 0.1 and sum(r.held_out for r in got) > 10
    assert sum(r.n_turns for r in got) == len(rows) and max(r.n_turns for r in got) == 8
    assert sum(r.part is None for r in got) == 2 and all(r.n_turns == 1 for r in got if r.part is None)  # no place in a conversation
    whole = {r.conv_id: r for r in formatted.filter("conv_id < 100").collect()}
    cut = {}
    for r in sorted(run(chat.transcripts(table, size=3), model).filter("conv_id < 100").collect(), key=lambda r: r.part):
        cut.setdefault(r.conv_id, []).append(r)
    assert max(map(len, cut.values())) == 3
    for i, parts in cut.items():
        assert "".join(r.rendered for r in parts) == whole[i].rendered
        assert [t.role for r in parts for t in r.turns if not t.goes_on] == [t.role for t in whole[i].turns]
    assert chat.transcripts(table.limit(0)).count() == 0
    assert chat.parse("User: hi\nthere\n\nBot: yes?\n", model) == [("user", "hi\nthere", False), ("assistant", "yes?", False)]
    assert chat.parse(None, model) == [] == chat.parse(" \n", model) and chat.render([("user", "a", False)]) == "<|user|>\na\n<|end|>\n"
    assert chat.parse("### Instruction:\ndo it\n### Response:\nok", model) == [("user", "do it", False), ("assistant", "ok", False)]
    none = chat.fit(raw.limit(0))
    assert chat.parse("Human: a\nAI: b", none) == [("user", "a", False), ("assistant", "b", False)]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no marker at all")], "id int, text string")
    assert [len(r.turns) for r in chat.format_transcripts(odd, model, ["id"]).orderBy("id").collect()] == [0, 0, 1]


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    start, move, emit = chat.Model.empty()
    model = chat.Model(start + rng.integers(0, 9, start.shape), move + rng.integers(0, 9, move.shape), [e + rng.integers(0, 9, e.shape) for e in emit])
    seen = np.stack([rng.integers(0, k, 4) for k in chat.SIZES], 1)
    score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:])) + sum(e[s, v] for s, row in zip(p, seen) for e, v in zip(model.emit, row))
    best = max(product(range(6), repeat=4), key=score)
    assert score(tuple(model.viterbi(seen))) == pytest.approx(score(best))


def brute_nearest(rows, queries, k=5):
    """rows and queries are (place, id, vector)."""
    out = []
    for p, i, v in queries:
        scored = []
        for o, j, w in rows:
            if o != p and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                scored.append((-(a @ b) / np.sqrt((a @ a) * (b @ b)), j))
        out += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((6, 24))
    data = [(i, (centers[i % 6] + rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(1500)]
    data[7] = (7, data[50][1])
    data += [(50, data[50][1]), (100, data[3][1]), (9, data[9][1]), (2300, [1.0, 2.0]), (2350, [2.0, 1.0])]  # repeated rows, shared ids, another dimension
    odd = [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] * 24), (2200, [1.0, None] * 12), (2250, [float("inf")] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("h", F.lit(0)).withColumn("score", F.lit(0)).withColumn("rid", F.lit(0))
    rows = [(p, i, v) for p, (i, v) in enumerate(data)]
    want = sorted(brute_nearest(rows, [x for x in rows if x[1] % 50 == 0]))
    for block in (7, 8192):
        got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 50 == 0, block=block).collect())
        assert len(got) == len(want) and sum(a == b for a, b in zip(got, want)) / len(want) >= 0.99
    assert got[0][0] == 0 and [r for r in got if r[:2] == (50, 1)] == [(50, 1, 7, 1.0)] * 2 and [r for r in got if r[:2] == (50, 2)] == [(50, 2, 50, 1.0)] * 2
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(i, [x * 1e200 for x in v]) for i, v in data[:100] if len(v) == 24], "vec_id long, embedding array<double>")
    want = [(q, n, j) for q, n, j, _ in brute_nearest(rows[:100], [x for x in rows[:100] if x[1] % 50 == 0])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(huge, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    q = ann._unit(rng.standard_normal((20, 64)))
    share = {}
    for bits in (64, 512):
        c, turn = ann.centroids(x[:500], 8), ann.rotation(64, bits, 5)
        np.testing.assert_allclose(turn @ turn.T, np.eye(64), atol=1e-9)
        code = ann.encode(x, c, turn)
        true, upper = q @ ann._unit(x).T, np.empty((20, 2000))
        for i in range(8):
            rows = np.flatnonzero(code[0] == i)
            upper[:, rows] = ann.bounds(code, q, i, rows, c, turn, 3.0)
        assert (true <= upper).mean() > 0.99
        share[bits] = (upper >= np.sort(true, 1)[:, -5:-4]).mean()  # what must be reranked if the k-th best is known
    assert share[512] < 0.1 < share[64]


def brute_similar(texts):
    """Pairs of five-word similarity 0.8 or more, and the first place of each text's group."""
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for w in (WORD.findall((t or "").lower()) for t in texts)]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(sets)))
    for a, b in pairs:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return pairs, root


def test_similar(spark):
    """Near copies far apart in SimHash go, less similar ones stay, rows without an id are judged."""
    rng = random.Random(21)
    rows = []
    for i in range(0, 60, 2):
        w = words(rng, 200, 5000)
        v = list(w)
        for j in rng.sample(range(200), (1, 3, 4, 9)[i // 2 % 4]):
            v[j] = f"z{j}"
        rows += [(i, " ".join(w), "en", "s"), (i + 1, "\n".join(v).upper(), "fr", None)]
    rows += [(None, rows[0][1], "en", "s"), (None, "alone a b", "en", "s"), (None, "alone a b", "en", "s"), (70, "x y", "en", "s"), (71, "X  Y", "en", "s"), (72, None, "en", "s"), (73, " ", "en", "s"), (74, "y x", "en", "s")]
    pairs, root = brute_similar([r[1] for r in rows])
    want = sorted(str(rows[x][0]) for x in set(root))
    assert 5 < sum(b < 60 for _, b in pairs) < 30
    df = frame(spark, rows)
    got = similar.keep_one(df)
    assert sorted(str(r.doc_id) for r in got.collect()) == want and got.columns == df.columns
    assert sorted(str(r.doc_id) for r in similar.keep_one(df, hot=2).collect()) == want
    assert similar.keep_one(df.limit(0)).count() == 0
    assert simhash.keep_one(df).filter("doc_id < 60").count() > sum(x != "None" and int(x) < 60 for x in want)


def test_similar_by_simhash(spark):
    """Fingerprints are SimHash's majority bits, and pairs at 0.8 meet through them, long sets and short ones."""
    rng = random.Random(14)
    rows, ways = [], ((6, 1), (9, 1), (14, 1), (24, 2), (60, 1), (300, 6), (2500, 50))
    for n, cuts in ways:
        for _ in range(12):
            w = words(rng, n, 10**6)
            other = list(w)
            for i in rng.sample(range(n), cuts):
                other[i] = "other"
            rows += [(len(rows), " ".join(w), "en", "s"), (len(rows) + 1, " ".join(w[: max(5, n - n // 6)]), "en", "s"), (len(rows) + 2, " ".join(other), "en", "s")]
    df = frame(spark, rows)
    found = similar._signatures(similar._keyed(df), 5, 0.8).collect()
    assert len(found) == len(rows)
    for r in found[::7]:
        (h,) = similar._sets(pa.array([rows[r._k][1]]), 5)
        for i, step in enumerate(similar._STREAM):
            bits = [[int(x) >> (8 * (b // 8) + 7 - b % 8) & 1 for b in range(64)] for x in mix(h + step)]
            assert list(np.unpackbits(np.frombuffer(r.bytes, np.uint8))[64 * i : 64 * i + 64]) == [2 * sum(b) > len(h) for b in zip(*bits)]
    pairs, root = brute_similar([r[1] for r in rows])
    assert len(pairs) > 60
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == sorted(set(root))


def test_kneser_ney_sorts_and_finds():
    """Questions and lookups by quick sorts, and word hashes from prefix sums, are what plain loops give."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys = rng.integers(0, 900, n, dtype=np.uint64) << np.uint64(55)
        assert kn_quality._distinct(keys).tolist() == sorted(set(keys.tolist()))
        known = {k: i for i, k in enumerate(sorted(set(keys.tolist()))[::2])}
        (got,) = kn_quality._find(keys, np.array(list(known), np.uint64), np.arange(len(known)) + 1)
        assert got.tolist() == [known[k] + 1 if k in known else 0 for k in keys.tolist()]
    texts = pa.array([None, "", " one  two\tthrée", "x" * 3000, "a\n", " "])
    want = []
    for t in ("one", "two", "thrée", "x" * 3000, "a"):
        total = sum(int(common._TABLE[b]) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(t.encode()))
        want.append(int(mix(np.array([(total + len(t.encode())) % (1 << 64)], np.uint64))[0]))
    assert common.Words(texts).hashes().tolist() == want


def test_pieces_of_latin_texts():
    """Latin-1 texts, cut in arrays, have the library's ids: pieces of over 16 bytes, of one class beside another, and every character."""
    rng = random.Random(8)
    texts = ["", " ", "a" * 17, f"{'a' * 16} {'a' * 18} {'b' * 8}{'c' * 9} {'b' * 8}{'c' * 10}", "=" * 40, "12345678901234567890", "x²½y", "a\x85b\xa0c"]
    texts += ["".join(rng.choice("abZé ñÀ12½²=+-\n\t\x7f\x05ÿß") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [chr(i) * 2 + "a" + chr(i) for i in range(256)]
    own = tokenbin.Encoder(path(), memory=40)
    assert sum(tokenbin._way(t) == tokenbin._BY_BYTE for t in texts) > 500
    want = [own.whole(t) for t in texts]
    assert own.encode(texts) == want and [x for t in texts for x in own.encode([t])] == want
    asked = []
    own.cache = tokenbin._Pieces(lambda piece: asked.append(piece) or own._piece(piece), {})
    own.encode(["one two one"] * 50)
    assert sorted(asked) == ["one", "two"]
