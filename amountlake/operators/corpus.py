"""Corpus work: amount-likelihood of lines, deduplicated samples, negatives, and checks of labelled lines."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.fold import evaluate
from ..functions.lexicon import PACKS, RANGE_SIGNS, key, lexicon, normalize, resolve_pack
from ..functions.normalize import clean, dedup_key, normalize_text
from ..runtime import ship
from .parse import parse_df
from .tagger import exact_class, split_word, tokens_of

WEIGHTS = dict.fromkeys(("SYMBOL", "UNIT", "PFX"), 4) | {"CUR": 3, "CARD": 1}


def lexicon_hits(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """id, signal, n, long: counts of lexicon hits by a join of words with the (small, fixed) lexicon."""
    from ..functions.lexicon import relation

    lex, spark = lexicon(), df.sparkSession
    forms = relation(spark).filter(~F.col("class").isin("O")).groupBy(F.lower("surface").alias("w")).agg(F.min("class").alias("class"))
    symbols = sorted(lex.symbols)
    money = sorted({m for m in lex.before | lex.after} | {m.rstrip(".") for m in lex.before})
    words = df.select(id_column, F.explode(F.regexp_extract_all(text, F.lit(r"[\wऀ-ॿ઀-૿]+"), 0)).alias("raw")).filter(~F.col("raw").isin(symbols))
    hits = words.join(F.broadcast(forms), F.lower("raw") == F.col("w")).select(id_column, F.substring_index("class", "_", 1).alias("signal"), (F.length("raw") > 3).alias("long"))
    raw = df.select(id_column, F.explode(F.split(text, r"\s+")).alias("raw"))
    currency = raw.filter(F.lower(F.regexp_replace("raw", r"^[.,:;!?]+|[.,:;!?]+$", "")).isin(money)).select(id_column, F.lit("CUR").alias("signal"), F.lit(True).alias("long"))
    sign = df.filter(F.col(text).contains("₹")).select(id_column, F.lit("CUR").alias("signal"), F.lit(True).alias("long"))
    glued = F.regexp_extract("raw", r"^[૦-૯०-९0-9,.]+([a-zA-Z]{1,4})$", 1)
    symbol = raw.filter(F.col("raw").isin(symbols) | glued.isin(symbols)).select(id_column, F.lit("SYMBOL").alias("signal"), F.lit(True).alias("long"))
    digits = df.filter(F.col(text).rlike(r"[\d०-९૦-૯]")).select(id_column, F.lit("DIGITS").alias("signal"), F.lit(True).alias("long"))
    every = hits.unionByName(currency).unionByName(sign).unionByName(symbol).unionByName(digits)
    return every.groupBy(id_column, "signal").agg(F.count("*").alias("n"), F.max("long").alias("long"))


def score_lines(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """df with signals (map), score and positive."""
    hits = lexicon_hits(df, id_column, text)
    short = F.when((F.col("signal") == "UNIT") & ~F.col("long"), True)
    by = hits.groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("signal", F.col("n").cast("int")))).alias("signals"), F.coalesce(F.max(short), F.lit(False)).alias("_short"))
    out = df.join(by, id_column, "left").withColumn("signals", F.coalesce("signals", F.create_map().cast("map<string,int>")))
    n = lambda s: F.coalesce(F.try_element_at("signals", F.lit(s)), F.lit(0))
    score = sum((n(s) * w for s, w in WEIGHTS.items()), F.lit(0))
    unit = (n("UNIT") > 0) & (~F.coalesce("_short", F.lit(False)) | (n("CARD") > 0) | (n("DIGITS") > 0))
    return out.withColumns({"score": score, "positive": (n("PFX") > 0) | (n("CUR") > 0) | (n("SYMBOL") > 0) | unit}).drop("_short")


def length_band(df: DataFrame, text: str = "text", least: int = 3, most: int = 40, chars: int = 128) -> DataFrame:
    """Cleaned lines of 3 to 40 words and at most 128 characters."""
    words = F.regexp_count(F.col(text), F.lit(r"\S+"))
    return df.withColumn(text, clean(F.col(text))).filter((words >= least) & (words <= most) & (F.length(text) <= chars))


def first_by_key(df: DataFrame, order: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The first line of each (language, key) in the given order; lines with an empty key go."""
    keyed = df.withColumn("_key", dedup_key(F.col(text))).filter("_key <> ''")
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(lang, "_key").orderBy(*order))).filter("_n = 1").drop("_n", "_key")


def hash_sample(df: DataFrame, n: int, seed: str, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """n rows (per group of ``by``), uniform by a seeded hash; the same rows on every run."""
    mark = df.withColumn("_h", F.xxhash64(F.lit(seed), text))
    if not by:
        return mark.orderBy("_h", text).limit(n).drop("_h")
    return mark.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h", text))).filter(F.col("_n") <= n).drop("_h", "_n")


def build_negatives(lines: DataFrame, gold: DataFrame, per_lang: int, seed: str = "17") -> DataFrame:
    """Lines without any signal, without a parsed amount and not in gold, as many for each language; text, lang, source."""
    pool = lines.filter((F.col("score") == 0))
    pool = pool.withColumn("_key", dedup_key(F.col("text"))).join(gold.select(dedup_key(F.col("text")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")
    twice = hash_sample(pool, 2 * per_lang, seed, ["lang"])
    return hash_sample(parse_df(twice).filter(F.size("amounts") == 0).drop("amounts"), per_lang, seed, ["lang"]).select("text", "lang", "source")


# labelled lines


def phrase_tokens(text: str, pack: str) -> list[tuple[str, str]]:
    """(class, text) of a phrase, or ValueError with the word no pack explains."""
    out: list[tuple[str, str]] = []
    raw = tokens_of(text)
    for i, (cls, piece, a, _) in enumerate(raw):
        if cls == "SIGN":
            near = [next((t[0] for t in side if t[0] != "SEP"), "") for side in (reversed(raw[:i]), raw[i + 1 :])]
            cls = "RANGE" if piece in RANGE_SIGNS and all(c.startswith(("DIGITS", "CARD_", "PFX_")) for c in near) else "SEP"
        elif cls == "O" and piece[0].isalpha() and exact_class(key(piece)) != "O":
            if key(piece) in lexicon().range_words and out and i + 1 < len(raw):
                cls = "RANGE"
            elif not (a and text[a - 1] in "'’" and len(piece) <= 2) and not split_word(piece, 0, (pack,)):
                raise ValueError(f"unknown_token:{piece}")
        out.append((cls, piece))
    return out


def occurrences(text: str, phrase: str) -> list[int]:
    """Starts at which the phrase stands between word boundaries; they may overlap."""
    word = lambda c: c.isalnum() or "ऀ" <= c <= "ॿ" or "઀" <= c <= "૿"
    found, at = [], text.find(phrase)
    while at >= 0 and phrase:
        end = at + len(phrase)
        left = at == 0 or not (word(text[at - 1]) and word(phrase[0]))
        right = end == len(text) or not (word(text[end]) and word(phrase[-1]))
        if left and right:
            found.append(at)
        at = text.find(phrase, at + 1)
    return found


def strip_currency(phrase: str) -> tuple[str, int, bool]:
    """A phrase without one leading marker and one trailing word: (rest, how far its start moved, whether any went)."""
    lex = lexicon()
    before = sorted(lex.before | {m.rstrip(".") for m in lex.before}, key=len, reverse=True)
    rest, moved, money = phrase, 0, False
    for m in before:
        if rest.startswith(m) and rest != m:
            cut = rest[len(m) :].lstrip()
            moved, rest, money = len(rest) - len(cut), cut, True
            break
    for w in sorted(lex.after, key=len, reverse=True):
        if rest.endswith(w) and rest != w:
            return rest[: -len(w)].rstrip(), moved, True
    return rest, moved, money


def has_quantity(text: str) -> bool:
    """Whether a line meant as negative holds a currency mark, a unit word, or a unit symbol behind three digits; ambiguous units need a number before them."""
    lex = lexicon()
    words = text.split()
    if "₹" in text or any(w.strip(".,:;!?") in lex.after | lex.before for w in words):
        return True
    tokens = [t for t in tokens_of(text) if t[0] != "SEP"]
    for before, t in zip([("", "", 0, 0), *tokens], tokens):
        if t[0].startswith("UNIT_"):
            numbered = before[0].startswith(("CARD_", "PFX_")) or (before[0] == "DIGITS" and len(before[1]) >= 3)
            if numbered or not (t[1] in lex.ambiguous or len(t[1]) <= 3):
                return True
    return False


def _close(a: float, b: float) -> bool:
    """Whether values are equal but for what evaluation rounds away (``fold.tidy``) and a few last bits; a share of the value would let rupees go by in large amounts."""
    return abs(a - b) <= max(1e-6, min(0.5, abs(b) * 1e-9)) + abs(b) * 4e-15


def check_line(row: dict, packs: tuple[str, ...] = PACKS) -> tuple[str | None, list[dict]]:
    """(reject reason or None, spans) of one line; order-dependent reasons (duplicates) are found by joins."""
    text, lang, phrases = row.get("text"), row.get("lang"), row.get("phrases")
    if row.get("_corrupt_record") is not None:
        return "malformed", []
    if lang not in packs:
        return "lang_mismatch", []
    if not text or not text.strip():
        return "missing_text", []
    if phrases is None:
        return "missing_phrases", []
    normal = normalize(text)
    if len(normal) != len(text):
        return "nfc_length_mismatch", []
    if not phrases:
        return ("negative_contains_quantity", []) if has_quantity(normal) else (None, [])
    spans: list[dict] = []
    pack = resolve_pack(lang)
    for p in phrases:
        if not p or not p["phrase"]:
            return "bad_phrase_entry", []
        if p["value"] is None:
            return "missing_value", []
        phrase = normalize(p["phrase"])
        starts = occurrences(normal, phrase)
        if not starts:
            return "phrase_not_found", []
        if len(starts) > 1:
            return "ambiguous_phrase", []
        rest, moved, money = strip_currency(phrase)
        start = starts[0] + moved
        if any(start < s["end"] and s["start"] < start + len(rest) for s in spans):
            return "overlapping_phrase", []
        try:
            tokens = phrase_tokens(rest, pack)
        except ValueError as error:
            return str(error), []
        value, low, high, unit = evaluate(tokens)
        claimed = p["range"]
        if not _close(value, p["value"]) or (claimed and (low is None or not (_close(low, claimed[0]) and _close(high, claimed[1])))):
            return "value_mismatch", []
        spans.append({"start": start, "end": start + len(rest), "value": value, "low": low, "high": high, "unit": unit, "currency": "INR" if money else None, "classes": " ".join(c for c, _ in tokens if c != "SEP")})
    return None, spans


CHECKED = "struct<reason:string,spans:array<struct<start:int,end:int,value:double,low:double,high:double,unit:string,currency:string,classes:string>>>"


def verify_lines(lines: DataFrame, gold: DataFrame | None = None, order: tuple[str, ...] = ("src_file", "src_line")) -> DataFrame:
    """lines (text, lang, phrases, order columns) with reason (null: accepted) and spans.

    ``dup`` marks all but the first accepted line of one normalized text, ``dup_gold`` lines whose text is in gold.
    """
    ship(lines.sparkSession)
    fields = ["text", "lang", "phrases", *(["_corrupt_record"] if "_corrupt_record" in lines.columns else [])]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        def plain(row: dict) -> dict:
            phrases = row["phrases"]
            row["phrases"] = None if phrases is None else [None if p is None else {k: (None if v is None else list(v) if k == "range" else v) for k, v in dict(p).items()} for p in phrases]
            return row

        got = [check_line(plain(r)) for r in rows.to_dict("records")]
        return pd.DataFrame({"reason": [g[0] for g in got], "spans": [g[1] for g in got]})

    out = lines.withColumn("_c", F.pandas_udf(run, CHECKED)(F.struct(*fields))).withColumn("_n", normalize_text(F.col("text")))
    if gold is not None:
        known = gold.select(normalize_text(F.col("text")).alias("_n"), F.lit(True).alias("_gold")).distinct()
        out = out.join(known, "_n", "left")
    else:
        out = out.withColumn("_gold", F.lit(None).cast("boolean"))
    early = F.coalesce(F.col("_c.reason").isin("malformed", "lang_mismatch", "missing_text", "missing_phrases", "nfc_length_mismatch"), F.lit(False))
    good = F.col("_c.reason").isNull() & F.col("_gold").isNull()
    before = F.coalesce(F.sum(F.when(good, 1)).over(Window.partitionBy("_n").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reason = F.when(early, F.col("_c.reason")).when(before > 0, "dup").when(F.col("_gold"), "dup_gold").otherwise(F.col("_c.reason"))
    return out.withColumns({"reason": reason, "spans": F.col("_c.spans")}).drop("_c", "_n", "_gold")


def reject_histogram(checked: DataFrame) -> DataFrame:
    """lang, reason (null: accepted), n."""
    return checked.groupBy("lang", F.regexp_extract(F.coalesce("reason", F.lit("")), "^[^:]*", 0).alias("reason")).agg(F.count("*").alias("n")).withColumn("reason", F.when(F.col("reason") != "", F.col("reason")))


def char_labels(length: Column, start: Column, end: Column) -> Column:
    """BIO label per character of a text with one span."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i == start, 1).when((i > start) & (i < end), 2).otherwise(0))



def mine_variants(romanised: DataFrame, known: DataFrame) -> DataFrame:
    """Spellings from rows (native, roman, n) whose native word, in any nukta spelling, is a lexicon form, and that aren't known yet: class, roman, n."""
    from ..functions.lexicon import relation

    plain = lambda c: F.regexp_replace(c, "़", "")
    forms = relation(romanised.sparkSession).filter(~F.col("surface").rlike("^[ -~]+$")).select(plain(F.col("surface")).alias("w"), "class").distinct()
    found = romanised.join(F.broadcast(forms), plain(F.col("native")) == F.col("w")).groupBy("class", F.lower("roman").alias("roman")).agg(F.sum("n").alias("n"))
    return found.join(known.select(F.lower("surface").alias("roman")).distinct(), "roman", "left_anti").select("class", "roman", "n")


LINE_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("range", T.ArrayType(T.DoubleType()))]))),
        T.StructField("scenario", T.StringType()),
        T.StructField("gen", T.StringType()),
    ]
)
