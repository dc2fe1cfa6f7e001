"""Personal data by patterns, and by contexts that bootstrap from what the patterns find.

Everything is DataFrame functions. The place of a match is found from the lengths of the matches and of the
text between them, so no text leaves the first projection.

Bootstrapping: words with a digit or an @ are instances, the two words before one are its pattern, whatever else those are
part of. Instances that a span of a base pattern covers, of whichever kind, are seeds with confidence 1 and count as
that span's text. Then the pattern-instance graph is scored in rounds: a pattern is worth the smoothed mean
confidence of its distinct instances, an instance the noisy-or of its patterns. Patterns that stay trustworthy
report the instances of six characters or more that no base pattern covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, quoted, temporary

#: The base patterns, in the order of their kinds. Each matches what the stated pattern matches from left to right;
#: possessive runs, and starts at a run's start or where the last match ended, keep them linear on long texts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of digits with single separators are maximal, so the count of digits can be asked for in the pattern.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")

#: A word; what follows it, without being consumed: a second word, and a third with a digit or an @. So every word can
#: begin a context, and contexts overlap.
CONTEXT = r"(?<!\S)(\S++\s++)(?=(\S++\s++)(?=[^\s0-9@]*+[0-9@])(\S++))"
#: Least characters of an instance that is reported.
LEAST = 6
#: Rounds of scoring; confidence, distinct instances and seeds that a pattern must have to report.
ROUNDS, CONFIDENCE, INSTANCES, SEEDS = 3, 0.8, 8, 5

_BLOCK = 256


def _matches(text: Column, pattern: str, worth: Column, name: str) -> list[Column]:
    """``<name>_m``: the matches; ``<name>_g``: the lengths of the stretches before, between and after them."""
    found = F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(worth, F.transform(F.split(text, pattern, -1), lambda s: F.length(s))).otherwise(F.array().cast("array<int>"))
    return [found.alias(f"{name}_m"), gaps.alias(f"{name}_g")]


def _starts(df: DataFrame, name: str) -> DataFrame:
    """Adds ``<name>_s``: the places of the matches in code points.

    Sums run over blocks first, so a text with very many matches costs little more than one block each.
    """
    m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
    steps = F.transform(m, lambda _, i: F.get(g, i).cast("long") + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0)))
    df = df.withColumn("__steps", steps)
    s = F.col("__steps")
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(s, k * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0).cast("long"), add))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    df = df.withColumn("__before", F.when(F.size(s) > 0, before))
    at = lambda _, i: F.get("__before", F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(s, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1), F.lit(0).cast("long"), add)
    return df.withColumn(f"{name}_s", F.transform(s, at)).drop("__steps", "__before")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.split(F.reverse(_digits(m)), "")
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: matches and gaps of every kind, and of the instances in context."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    docs = df.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    digit = t.rlike("[0-9]")
    worth = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": t.contains("+")}
    pick = lambda k: F.when(digit | t.contains("@"), F.regexp_extract_all(t, F.lit(CONTEXT), F.lit(k))).otherwise(F.array().cast("array<string>"))
    cols = [c for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for c in _matches(t, p, worth[kind], kind)]
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), *cols, *_matches(t, CONTEXT, digit | t.contains("@"), "id"), pick(2).alias("id_next"), pick(3).alias("id_word"))


def base_spans(found: DataFrame) -> DataFrame:
    """Replaces the columns of the base kinds by ``base``: an array of (kind, start, end, hash of the text), by kind and start."""
    for kind in KINDS[:4]:
        found = _starts(found, kind)

    def spans(k: int, kind: str) -> Column:
        both = F.arrays_zip(F.col(f"{kind}_s").alias("s"), F.col(f"{kind}_m").alias("m"))
        fine = F.filter(both, lambda z: _valid(kind, z["m"]))
        return F.transform(fine, lambda z: F.struct(F.lit(k).alias("kind"), z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), F.xxhash64(F.lower(z["m"])).alias("text")))

    return found.withColumn("base", F.concat(*(spans(k, kind) for k, kind in enumerate(KINDS[:4])))).drop(*(f"{k}_{x}" for k in KINDS[:4] for x in "mgs"))


def occurrences(found: DataFrame) -> DataFrame:
    """``doc_id, row_key, pattern, instance, start, end, seed``: instances in context, one row each, named by a hash.

    What a base span covers is a seed of any length.
    """
    placed = _starts(found.filter(F.size("id_m") > 0), "id")
    each = F.arrays_zip(F.col("id_s").alias("s"), F.col("id_m").alias("first"), F.col("id_next").alias("second"), F.col("id_word").alias("word"))
    rows = placed.select("doc_id", "row_key", "base", F.explode(each).alias("o"))
    word = F.regexp_replace(F.col("o.word"), r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", "")
    lead = F.length(F.regexp_extract("o.word", r"^[\"'(\[<]*", 0))
    start = F.col("o.s") + F.length("o.first") + F.length("o.second") + lead
    left = F.lower(F.regexp_replace(F.concat("o.first", "o.second"), r"\s+", " "))
    out = rows.select("doc_id", "row_key", "base", left.alias("pattern"), F.lower(word).alias("word"), start.alias("start"), (start + F.length(word)).alias("end"))
    out = out.withColumn("of", F.get(F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))), F.lit(0)))
    seed = F.col("of").isNotNull()
    return out.filter(seed | (F.length("word") >= LEAST)).select("doc_id", "row_key", "pattern", F.coalesce(F.col("of.text"), F.xxhash64("word")).alias("instance"), "start", "end", seed.alias("seed"))


def score_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, trust, instances, seeds`` after ``rounds`` of scoring the pattern-instance graph."""
    edges = materialise(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    conf = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("confidence"))
    for k in range(rounds):
        trust = edges.join(conf, "instance").groupBy("pattern").agg((F.sum("confidence") / (F.count(F.lit(1)) + 1)).alias("trust"), F.count(F.lit(1)).alias("instances"), F.count_if("seed").alias("seeds"))
        trust = materialise(trust, "pii-trust")
        if k + 1 < rounds:
            doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))
            conf = materialise(edges.join(trust.select("pattern", "trust"), "pattern").groupBy("instance").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - F.exp(doubt)).alias("confidence")), "pii-confidence")
    return trust


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, base, found``: arrays of (kind, start, end) in code points, by kind as listed and start.

    ``base`` are the matches of the base patterns, ``found`` what contexts add. Null and empty texts have none.
    Rows that repeat id and text get the same spans, and count once in a pattern's distinct instances. An empty
    table gives an empty result; other columns are not looked at.
    """
    with temporary(df.sparkSession) as keep:
        return keep(_find(df, id_col, text_col, rounds), "pii-result")


def _find(df: DataFrame, id_col: str, text_col: str, rounds: int) -> DataFrame:
    spans = materialise(base_spans(materialise(base_matches(df, id_col, text_col), "pii-matches")), "pii-base")
    seen = materialise(occurrences(spans), "pii-seen")
    good = score_patterns(seen, rounds).filter((F.col("trust") >= CONFIDENCE) & (F.col("instances") >= INSTANCES) & (F.col("seeds") >= SEEDS)).select("pattern")
    new = seen.filter(~F.col("seed")).join(good, "pattern").groupBy(F.col("doc_id").alias("n_id"), F.col("row_key").alias("n_key")).agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("found"))
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    joined = spans.select("doc_id", "row_key", base.alias("base")).join(new, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("row_key") == F.col("n_key")), "left")
    return joined.select("doc_id", "base", F.coalesce(F.array_sort("found"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("found"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame) -> DataFrame:
    """The digest columns, derived from the spans of ``find``: a row per row, null texts counting as empty."""
    out = find(df.select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *map(count, range(4)), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "found")).alias("spans"))
