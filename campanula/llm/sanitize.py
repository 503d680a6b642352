"""Personal data: fixed patterns, and terms that reveal a protected entity.

Column expressions, joins and aggregations only. Each pattern's matches and the text
between them give the places of all matches. Entities are the valid matches. For every
entity and every term of the texts that hold it, wherever it stands, corpus counts of
documents give the pointwise mutual information; as a share of the entity's own
information it says how much of the entity the term gives away (1: whoever sees the term
knows the entity). Terms at or above the threshold are spans too: generalised if they are
names or numbers, else removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.llm.common import cut, let, stored, text_or_empty, words

#: Share of an entity's information that a term may give away, and in how many documents
#: they have to meet before that counts as knowledge.
DISCLOSED = 0.8
LEAST_JOINT = 3

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "removed")
EDGES = ".,;:!?()[]{}\"'<>|*#$%&"

SPAN = "struct<kind:string,start:int,end:int,value:string>"

# A match starts where the one before ended, or where no character stands before it that
# would have belonged to it: the same matches as without that, found in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")),
    "card": lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
VALUE: dict[str, Callable[[Column], Column]] = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}


def _span(kind: str | Column, start: Column, end: Column, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (m, start) for all matches, leftmost and without overlap; code points from 0."""
    empty = F.array().cast("array<struct<m:string,start:int>>")

    def placed(found: Column) -> Column:
        def of(between: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(between, i))
                m = F.get(found, i)
                row = F.struct(m.alias("m"), start.alias("start"))
                return F.struct((start + F.length(m)).alias("at"), F.array_append(acc["rows"], row).alias("rows"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), empty.alias("rows")), step, lambda acc: acc["rows"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """All valid matches, by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for kind in BASE:
        good = _kept(_matches(text, PATTERNS[kind]), VALID[kind])
        spans = _as_spans(good, kind, VALUE[kind])
        needed = NEEDED[kind]
        parts.append(F.when(F.contains(text, F.lit(needed)), spans).otherwise(none) if needed else spans)
    return F.concat(*parts)


def _kept(rows: Column, valid: Callable[[Column], Column]) -> Column:
    return F.filter(rows, lambda x: valid(x["m"]))


def _as_spans(rows: Column, kind: str, value: Callable[[Column], Column]) -> Column:
    return F.transform(rows, lambda x: _span(kind, x["start"], x["start"] + F.length(x["m"]), value(x["m"])))


def _term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGES))


def _pieces(text: Column, spans: Column) -> Column:
    """Array of (at, fields, first, stop): the text between spans in blank-separated fields.

    Fields from ``first`` up to before ``stop`` touch no span; ``at`` is where field 0 starts.
    """
    none = F.array().cast("array<struct<at:int,fields:array<string>,first:int,stop:int>>")
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    ends = F.concat(by_start, F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"))))

    def of(flat: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            def row(fields: Column) -> Column:
                stop = F.size(fields) - F.when(s["start"] == F.length(flat), 0).otherwise(1)
                return F.struct(acc["at"].alias("at"), fields.alias("fields"), F.when(acc["at"] == 0, 0).otherwise(1).alias("first"), stop.alias("stop"))

            piece = let(F.split(F.substr(flat, acc["at"] + 1, s["start"] - acc["at"]), " ", -1), row)
            rows = F.when(s["start"] >= acc["at"], F.array_append(acc["rows"], piece)).otherwise(acc["rows"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), rows.alias("rows"))

        return F.aggregate(ends, F.struct(F.lit(0).alias("at"), none.alias("rows")), step, lambda acc: acc["rows"])

    return let(F.translate(text, "\t\n\x0b\f\r", " " * 5), of)


def _terms(text: Column, spans: Column) -> Column:
    """Distinct terms of the whole text, but for words that touch a span."""
    free = F.flatten(F.transform(_pieces(text, spans), lambda p: F.slice(p["fields"], p["first"] + 1, F.greatest(p["stop"] - p["first"], F.lit(0)))))
    return F.array_remove(F.array_distinct(F.transform(free, _term)), F.lit(""))


def _places(text: Column, spans: Column, wanted: Column) -> Column:
    """Array of spans for every place of the ``wanted`` terms, but for words that touch a span."""
    none = F.array().cast(f"array<{SPAN}>")
    named = r"^\p{Lu}|[0-9]"

    def of_piece(p: Column, buckets: Column) -> Column:
        def asked(i: Column) -> Column:
            return let(_term(F.get(p["fields"], i)), lambda t: F.array_contains(F.get(buckets, F.pmod(F.xxhash64(t), F.size(buckets)).cast("int")), t))

        def step(acc: Column, i: Column) -> Column:
            word = F.get(p["fields"], i)
            skipped = F.length(F.array_join(F.slice(p["fields"], acc["next"] + 1, i - acc["next"]), " ")) + F.when(i > acc["next"], 1).otherwise(0)

            def row(at: Column) -> Column:
                inner = F.btrim(word, F.lit(EDGES))
                start = at + F.length(word) - F.length(F.ltrim(word, F.lit(EDGES)))
                span = _span(F.when(inner.rlike(named), "general").otherwise("removed"), start, start + F.length(inner), _term(word))
                return F.struct((at + F.length(word) + 1).alias("at"), (i + 1).alias("next"), F.array_append(acc["rows"], span).alias("rows"))

            return let(acc["at"] + skipped, row)

        free = F.when(p["stop"] > p["first"], F.sequence(p["first"], p["stop"] - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(p["at"].alias("at"), F.lit(0).alias("next"), none.alias("rows"))
        return F.aggregate(F.filter(free, asked), start, step, lambda acc: acc["rows"])

    def dealt(n: Column) -> Column:
        # a word is compared with the terms of its bucket alone
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(wanted, lambda t: F.pmod(F.xxhash64(t), n) == b))

    buckets = let(F.greatest(F.ceil(F.sqrt(F.size(wanted))).cast("int"), F.lit(1)), dealt)
    return let(buckets, lambda b: F.flatten(F.transform(_pieces(text, spans), lambda p: of_piece(p, b))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosed: float = DISCLOSED, least_joint: int = LEAST_JOINT) -> DataFrame:
    """Rows (id, digest, spans) for every document; spans by kind as listed, then start.

    ``digest`` is the text's hash. Null texts count as empty. Repeated rows give their
    rows each, and count as one document in the statistics.
    """
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    both = let(base_spans(F.col("text")), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, F.col("text")).alias("text")))
    found = stored(docs.select("id", "digest", both.alias("f")).select("id", "digest", "f.*"))
    n_docs = found.select("id", "digest").distinct().agg(F.count("*").alias("n_docs"))
    holders = found.select("id", "digest", F.explode("spans").alias("s"))
    holders = cut(holders.select("id", "digest", F.concat_ws(":", "s.kind", "s.value").alias("entity")).distinct())
    entities = holders.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # a pair meets in no more documents than hold its entity
    entities = cut(entities.filter(F.col("n_entity") >= least_joint).join(F.broadcast(n_docs)).filter("n_entity < n_docs"))
    held = holders.join(entities.select("entity"), "entity").groupBy("id", "digest").agg(F.collect_set("entity").alias("entities"))
    held = held.withColumnsRenamed({"id": "_id", "digest": "_digest"})
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    texts = found.filter("text IS NOT NULL").join(held, on).dropDuplicates(["id", "digest"])
    held = stored(texts.select("id", "digest", "text", "spans", "entities", _terms(F.col("text"), F.col("spans")).alias("terms")))
    pairs = held.select("id", "digest", F.explode("entities").alias("entity"), "terms").select("id", "digest", "entity", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_joint"))
    joint = cut(joint.filter(F.col("n_joint") >= least_joint))
    of_doc = F.array_distinct(F.transform(words(F.lower("text")), lambda w: F.xxhash64(F.btrim(w, F.lit(EDGES)))))
    # one row per word, counted in each task first, before it meets the terms
    counts = docs.select(F.explode(of_doc).alias("key")).groupBy("key").agg(F.count("*").alias("n_term"))
    shares = joint.withColumn("key", F.xxhash64("term")).join(counts, "key").join(entities, "entity")
    information = F.log(F.col("n_docs") / F.col("n_entity"))
    mutual = F.log(F.col("n_docs") * F.col("n_joint") / (F.col("n_term").cast("double") * F.col("n_entity")))
    telling = cut(shares.filter(mutual >= disclosed * information).select("entity", "term"))
    wanted = pairs.join(telling, ["entity", "term"]).groupBy("id", "digest").agg(F.collect_set("term").alias("wanted"))
    wanted = cut(wanted.withColumnsRenamed({"id": "_id", "digest": "_digest"}))
    extra = held.join(wanted, on).select("_id", "_digest", F.array_sort(_places(F.col("text"), F.col("spans"), F.col("wanted"))).alias("extra"))
    extra = cut(extra)
    out = found.select("id", "digest", "spans").join(extra, on, "left")
    return out.select("id", "digest", F.concat("spans", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span masked by ``<kind>``, removed terms by nothing."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with all spans in ``text_col`` generalised or removed; null texts stay null."""
    found = find(docs, id_col, text_col, **limits).filter(F.size("spans") > 0).dropDuplicates(["id", "digest"])
    found = cut(found.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans")))
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_digest"))
    text = F.when(F.col("_spans").isNotNull(), replaced(F.col(text_col), F.col("_spans"))).otherwise(F.col(text_col))
    return docs.join(found, on, "left").withColumn(text_col, text).select(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    s = F.col("spans")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(*kinds: str) -> Column:
        return F.filter(s, lambda x: x["kind"].isin(*kinds))

    return find(docs.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
