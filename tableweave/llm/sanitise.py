"""Personal data: base patterns, and terms that the corpus shows to reveal them.

Base spans of four kinds come from patterns. The terms (words of four letters or more)
of every text that holds an entity, the value found, are weighed by how much they disclose
about it, wherever in the text they stand:

    PMI(t; e) = log2(N n(t, e) / (n(t) n(e)))        IC(e) = log2(N / n(e))

with counts of rows over the whole corpus. PMI / IC is 1 if the term always comes with
the entity. At ``generalise`` or more the term becomes ``[TERM]``, at ``remove`` or more
it goes, at every place in the texts that hold that entity, and only there, so that
documents without personal data are left alone. Copies of one passage are one piece of
evidence: texts whose matches of the entity have the same ``WINDOW`` characters on both
sides count once towards ``support``.

DataFrame functions only. Positions come from splitting a text at the matches and summing
lengths per document and kind; nothing grows with the square of the matches. A term meets
an entity only if its count allows the share at all: n(t) of at most N (n(e) / N) **
``generalise``. Matches, those pairs and the texts that hold an entity are shuffled, keyed
by id and text hash; counts are combined before their shuffle, so that an entity that a
third of all documents name is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# The kinds in the order of their names in results, and their patterns.
# Look-behinds and possessive quantifiers keep matching linear in the text; they match
# what the plain patterns match from the left.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
TERM = "term"
_TERM_WORD = r"\p{L}{4,}"
WINDOW = 120

_KEY = ["id", "h"]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "(?<=.)(?=.)")
    doubled = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    """Whether a match of the pattern counts."""
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    n = F.length(_digits(hit))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", n.between(12, 19) & _luhn(_digits(hit)))
        .otherwise(n.between(9, 15))
    )


def _with_window(kind: str):
    def one(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), z["hit"].alias("hit"),
            F.length(z["before"]).alias("gap"),
            F.substring(z["before"], -WINDOW, WINDOW).alias("before"),
            F.substring(z["after"], 1, WINDOW).alias("after"),
        )

    return one


def _matches(docs: DataFrame) -> DataFrame:
    """One row per match: key, kind, start and end in code points, text and window."""
    text = F.col("text")
    found = docs.where(text.rlike("@|[0-9]"))
    for kind in KINDS:
        hinted = F.when(text.rlike(_HINTS[kind]), text).otherwise("")
        found = found.withColumn(f"{kind}_hits", F.regexp_extract_all(hinted, F.lit(PATTERNS[kind]), F.lit(0)))
    for kind in KINDS:
        found = found.withColumn(
            f"{kind}_parts", F.when(F.size(f"{kind}_hits") > 0, F.split("text", PATTERNS[kind], -1))
        )
    every = []
    for kind in KINDS:
        hits, parts = F.col(f"{kind}_hits"), F.col(f"{kind}_parts")
        zipped = F.arrays_zip(hits.alias("hit"), parts.alias("before"), F.slice(parts, 2, F.size(hits) + 1).alias("after"))
        every.append(F.coalesce(F.transform(zipped, _with_window(kind)), F.array()))
    rows = found.select(*_KEY, F.explode(F.concat(*every)).alias("m")).select(*_KEY, "m.*").where("hit is not null")
    # Repeated rows have equal matches; ``copies`` counts them.
    rest = [F.first(c).alias(c) for c in rows.columns if c not in (*_KEY, "kind", "pos")]
    rows = stored(rows.groupBy(*_KEY, "kind", "pos").agg(*rest, F.count("*").alias("copies")))
    upto = Window.partitionBy(*_KEY, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto))
    return rows.withColumn("start", F.col("end") - F.length("hit")).where(_holds(F.col("kind"), F.col("hit")))


def _with_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' columns where id and hash agree, null ids included."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in _KEY})
    return left.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).drop("_id", "_h")


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM_WORD), F.lit(0))), F.lower))


def _telling(docs: DataFrame, matches: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(id, h, term, removed): terms above the thresholds for an entity that the text holds."""
    total = docs.count()
    value = F.when(F.col("kind") == "email", F.lower("hit")).when(F.col("kind") == "ip", F.col("hit")).otherwise(_digits(F.col("hit")))
    mentions = matches.select(
        *_KEY, F.concat_ws(":", "kind", value).alias("entity"), F.xxhash64("before", "hit", "after").alias("window"), "copies"
    ).distinct()
    holders = stored(
        mentions.groupBy("entity", *_KEY).agg(F.bit_xor("window").alias("evidence"), F.max("copies").alias("copies"))
    )
    # An entity of all documents discloses nothing.
    entities = (
        holders.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.countDistinct("evidence").alias("pieces"))
        .where((F.col("pieces") >= support) & (F.col("n_entity") < total)).drop("pieces")
    )
    # n(t, e) is at most n(e); the last factor is for rounding.
    n, whole = F.col("n_entity"), F.lit(float(total))
    entities = entities.withColumn("most", whole * F.pow(n / whole, F.lit(generalise)) * (1 + 1e-9))
    judged = stored(holders.drop("copies").join(entities, "entity"))
    most = judged.agg(F.max("most")).first()[0] or 0.0

    in_docs = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    in_docs = in_docs.where(F.col("n_term").between(support, most))
    reach = judged.groupBy(*_KEY).agg(F.max("most").alias("reach"))
    words = _with_key(docs, reach).select(*_KEY, "reach", F.explode(_words(F.col("text"))).alias("term"))
    words = words.join(in_docs, "term").where(F.col("n_term") <= F.col("reach")).drop("reach")
    pairs = stored(_with_key(words, judged).where(F.col("n_term") <= F.col("most")).drop("most"))
    share = F.log2(whole * F.col("n_both") / (F.col("n_term") * n)) / F.log2(whole / n)
    telling = (
        pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"), F.countDistinct("evidence").alias("pieces"))
        .where(F.col("pieces") >= support).withColumn("share", share).where(F.col("share") >= generalise)
        .select("entity", "term", (F.col("share") >= remove).alias("removed"))
    )
    return pairs.join(telling, ["entity", "term"]).groupBy(*_KEY, "term").agg(F.max("removed").alias("removed"))


def _occurrences(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(id, h, kind, start, end, removed) of every place of a text's telling terms."""
    told = telling.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("told"))
    # Repeated rows are told apart, so that their sums do not run into each other.
    rows = _with_key(docs, told).select(
        *_KEY, "told", F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all("text", F.lit(_TERM_WORD), F.lit(0)).alias("words"), F.split("text", _TERM_WORD, -1).alias("gaps"),
    )
    each = F.transform(
        F.arrays_zip("words", F.slice("gaps", 1, F.size("words")).alias("gaps")),
        lambda z: F.struct(
            F.try_element_at("told", F.lower(z["words"])).alias("removed"),
            F.length(z["words"]).alias("n"), F.length(z["gaps"]).alias("gap"),
        ),
    )
    places = rows.select(*_KEY, "row", F.posexplode(each).alias("i", "w")).select(*_KEY, "row", "i", "w.*")
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).where("removed is not null")
    return places.select(
        *_KEY, F.lit(TERM).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end", "removed"
    ).distinct()


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    support: int = 3, generalise: float = 0.8, remove: float = 0.9,
) -> DataFrame:
    """(id, h, kind, start, end, removed) of every span; h is the hash of the text.

    Starts and ends count code points, ends exclusive. Base kinds are ``KINDS``; ``term``
    spans have ``removed`` true or false, base ones null. Null texts are empty texts.
    Equal rows give their spans once; no rows give no spans.
    """
    docs = _keyed(documents, id_col, text_col)
    base = stored(_matches(docs))
    found = _occurrences(docs, _telling(docs, base, support, generalise, remove))
    kept = base.select(*_KEY, "kind", F.col("start").cast("long"), F.col("end").cast("long"), F.lit(None).cast("boolean").alias("removed"))
    # What a base span covers needs no second one.
    before = Window.partitionBy(*_KEY).orderBy("start", F.col("kind") == TERM).rowsBetween(Window.unboundedPreceding, 0)
    every = kept.unionByName(found).withColumn("covered", F.max(F.when(F.col("kind") != TERM, F.col("end"))).over(before))
    outside = (F.col("kind") != TERM) | F.col("covered").isNull() | (F.col("end") > F.col("covered"))
    return stored(every.where(outside).drop("covered"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), kind)


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, counts of base spans, SHA-256 of their list, and the list of all spans.

    A list reads kind:start:end by start, then kind; without spans it is empty.
    """
    found = spans(documents, id_col, text_col, **options)
    entry = F.struct(
        F.col("start"), _rank(F.col("kind")).alias("rank"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("shown")
    )
    is_base = F.col("kind") != TERM
    listed = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda e: e["shown"]))
    per_doc = found.groupBy(*_KEY).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        listed(F.collect_list(F.when(is_base, entry))).alias("base"),
        listed(F.collect_list(entry)).alias("spans"),
    )
    rows = _keyed(documents, id_col, text_col).select("id", "h").alias("d")
    p = per_doc.alias("p")
    joined = rows.join(p, F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.h") == F.col("p.h")), "left")
    return joined.select(
        F.col("d.id").alias(id_col),
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitised(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with base spans replaced by their kind, telling terms generalised or removed.

    Overlapping spans become one that takes the kind of its first. All columns stay; null
    texts stay null.
    """
    found = spans(documents, id_col, text_col, **options).withColumn("rank", _rank(F.col("kind")))
    by_start = Window.partitionBy(*_KEY).orderBy("start", "rank", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("opens", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    label = (
        F.when(F.col("kind") != TERM, F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
        .when(F.col("removed"), "").otherwise("[TERM]")
    )
    merged = islands.groupBy(*_KEY, "island").agg(
        F.min(F.struct("start", "rank", label.alias("label")))["label"].alias("label"),
        F.min("start").alias("start"), F.max("end").alias("end"),
    )
    after = F.lag("end", 1, 0).over(Window.partitionBy(*_KEY).orderBy("start"))
    cuts = merged.withColumn("after", after).groupBy("id", "h").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "after", "label"))).alias("cuts")
    ).select(F.col("id").alias("_cut_id"), F.col("h").alias("_cut_h"), F.col("cuts").alias("_cuts"))
    own = F.col("_row").getField(text_col).cast("string")
    rows = documents.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_h"))
    joined = rows.join(
        cuts, F.col("_row").getField(id_col).eqNullSafe(F.col("_cut_id")) & (F.col("_h") == F.col("_cut_h")), "left"
    )
    pieces = F.transform(
        "_cuts",
        lambda c: F.concat(own.substr(c["after"].cast("int") + 1, (c["start"] - c["after"]).cast("int")), c["label"]),
    )
    tail = own.substr(F.element_at("_cuts", -1)["end"].cast("int") + 1, F.length(own))
    text = F.when(F.col("_cuts").isNull(), own).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(F.col("_row").withField(text_col, text).alias("_row")).select("_row.*")
