"""Op 2, document fingerprints: a Merkle tree over paragraphs and sections. DataFrame functions only.

A text falls into paragraphs at line ends, a paragraph into leaves. A leaf ends at a sentence's end or, as its content
has it, after a word of certain last letters, but not before 16 code points; without either, 96 code points are one, so
texts without sentences or blanks have leaves too. A section is a run of paragraphs; it ends at an empty line or at a
paragraph whose digest begins with one of four hex digits. So an edit moves no boundary but those beside it. A
paragraph's digest is that of its leaves' digests, a section's that of its paragraphs', the root's that of the sections'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.session import read_table

#: Rows that one range of ids should have, and the ranges whose bounds come from quantiles; each of these falls into as
#: many equal parts as the table needs.
RANGE_ROWS, COARSE = 512, 1024

#: A leaf; no character is lost.
_LEAF = r"(?s).{16,96}?(?:[.!?]\x20+|[adgilmouyz,;:]\x20|\z)|.{1,96}"


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def _paragraph(p: Column) -> Column:
    leaves = F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)))
    return F.transform(F.array(F.transform(leaves, _digest)), lambda xs: F.struct(_digest(F.array_join(xs, "")).alias("d"), F.transform(xs, lambda x: F.substring(x, 1, 8)).alias("leaves"), (p == "").alias("blank")))[0]


def add_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each ``{name: text column}`` the fingerprint of the whole text: ``root/section;section...``.

    root: 64 hex digits. A section: 16 digits of its digest, ``=``, its leaves joined by commas; a leaf: 8 digits of its
    digest. So prose takes about a third of its length, and no text of n code points on l lines more than 100 + 0.6 n + 27 l.
    A null text counts as empty; an empty text is one empty leaf; repeated rows stay; an empty table gives an empty one.
    Other columns stay, but for those of the new names, which are replaced, and of these with ``__p``, ``__e`` or ``__s``
    at their end. The steps are columns of their own, so each is computed once.
    """
    df = df.withColumns({f"{n}__p": F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1), _paragraph) for n, c in columns.items()})

    def ends(paragraphs: Column) -> Column:
        closes = lambda p, i: p["blank"] | F.substring(p["d"], 1, 1).isin("0", "1", "2", "3") | (i == F.size(paragraphs) - 1)
        return F.filter(F.transform(paragraphs, lambda p, i: F.when(closes(p, i), i)), lambda i: i.isNotNull())

    df = df.withColumns({f"{n}__e": ends(F.col(f"{n}__p")) for n in columns})

    def sections(paragraphs: Column, last: Column) -> Column:
        before = lambda k: F.when(k == 0, -1).otherwise(F.get(last, k - 1))
        own = F.transform(last, lambda e, k: F.slice(paragraphs, before(k) + 2, e - before(k)))
        return F.transform(own, lambda ps: F.struct(_digest(F.array_join(F.transform(ps, lambda p: p["d"]), "")).alias("digest"), F.flatten(F.transform(ps, lambda p: p["leaves"])).alias("leaves")))

    df = df.withColumns({f"{n}__s": sections(F.col(f"{n}__p"), F.col(f"{n}__e")) for n in columns})

    def written(s: Column) -> Column:
        parts = F.transform(s, lambda x: F.concat(F.substring(x["digest"], 1, 16), F.lit("="), F.array_join(x["leaves"], ",")))
        return F.concat(_digest(F.array_join(F.transform(s, lambda x: x["digest"]), "")), F.lit("/"), F.array_join(parts, ";"))

    df = df.withColumns({n: written(F.col(f"{n}__s")) for n in columns})
    return df.drop(*[f"{n}__{k}" for n in columns for k in "pes"])


def leaves_of(fingerprint_col: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    sections = F.split(F.substring(fingerprint_col, 66, 1 << 30), ";", -1)
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, 18, 1 << 30), ",", -1))))


def likeness(root_a: Column, root_b: Column, a: Column, b: Column) -> Column:
    """From 0 to 1, of two fingerprints and their ``leaves_of``: twice the leaves that both have, in proportion to those of
    both; 1 for equal roots only, 0 if nothing is shared."""
    share = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when(F.substring(root_a, 1, 64) == F.substring(root_b, 1, 64), F.lit(1.0)).otherwise(share)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of ``a`` that ``b`` doesn't have: where the branches below the roots differ."""
    names = lambda x: F.transform(F.split(F.substring(x, 66, 1 << 30), ";", -1), lambda s: F.substring(s, 1, 16))
    own, other = names(a), names(b)
    return F.filter(F.transform(own, lambda s, i: F.when(F.array_contains(other, s), None).otherwise(i)), lambda i: i.isNotNull())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text. A null text is empty; repeated rows stay; other columns are left out."""
    own = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return add_fingerprints(own, {"fingerprint": "text"}).select("doc_id", "fingerprint")


def with_next_text(df: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the text of the next row by doc_id; after the last comes the first; null ids first. Rows of
    one id follow each other by a hash of their texts. Null texts are empty; other columns are left out; an empty table
    gives an empty one.

    Rows are dealt out by ranges of doc_id: from approximate quantiles, then in equal parts, so their number grows with
    the table; an id of very many rows, or the null id, is dealt out by that hash (equal texts of one id stay together).
    Each text is shuffled once; only the first row of each range travels again, to the range before.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    count, nulls, low, high = rows.select(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(2, min(256, count // 8), count // RANGE_ROWS)
    coarse = min(ranges, COARSE)
    fine = -(-ranges // coarse)
    quantiles = rows.select(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 20 * coarse)).first()[0] or []
    bounds = sorted(set(quantiles))
    hot = sorted({x for x, y in zip(quantiles, quantiles[1:]) if x == y})
    split = max(1, max((quantiles.count(x) for x in hot), default=0) * fine, -(-nulls // RANGE_ROWS))
    fan = max(2, int(len(bounds) ** 0.5))
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    tops = bounds[fan - 1 :: fan]
    groups = [bounds[i * fan : (i + 1) * fan] for i in range(len(tops) + 1)]
    rows = rows.withColumn("top", F.when(F.col("doc_id").isNull(), 0).otherwise(below(longs(tops))))
    rows = rows.withColumn("part", F.col("top") * fan + below(F.element_at(F.array(*map(longs, groups)), F.col("top") + 1)))
    ends = longs([low, *bounds, high])
    begin, end = (F.element_at(ends, F.col("part") + k).cast("double") for k in (1, 2))
    step = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("doc_id").cast("double") - begin) / (end - begin + 1) * fine)))
    spread = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(hot), F.least(F.lit(split - 1), F.floor((F.col("hash").cast("double") / float(1 << 64) + 0.5) * split))).otherwise(0)
    place = F.when(F.col("doc_id").isNull(), spread - split).otherwise((F.col("part") * fine + step) * split + spread)
    rows = rows.select(place.cast("long").alias("range"), "doc_id", "hash", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("text").asc()]
    after = F.lead("text").over(Window.partitionBy("range").orderBy(*order))
    inside = rows.select("range", "doc_id", "text", after.alias("after"))
    heads = rows.groupBy("range").agg(F.min(F.struct("doc_id", "hash", "text")).alias("head"))
    heads = heads.select("range", F.col("head.text").alias("head"))
    names = heads.select("range").distinct()
    ring = Window.orderBy("range")
    succ = names.select(F.col("range").alias("range"), F.coalesce(F.lead("range").over(ring), F.min("range").over(ring)).alias("succ"))
    heads = heads.withColumnRenamed("range", "succ").join(succ, "succ").select("range", "head")
    return inside.join(heads, "range").select("doc_id", "text", F.coalesce("after", "head").alias("next_text"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents``, whole and edited; null texts are empty, rows that repeat an id stay, an empty table has none."""
    rows = with_next_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    rows = add_fingerprints(rows, {"fingerprint": "text", "edited_fingerprint": "edited", "next_fingerprint": "next_text"}).drop("text", "edited", "next_text")
    own, new, after = "fingerprint", "edited_fingerprint", "next_fingerprint"
    rows = rows.withColumns({f"{x}__leaves": leaves_of(F.col(x)) for x in (own, new, after)})
    near = lambda x: likeness(F.col(own), F.col(x), F.col(f"{own}__leaves"), F.col(f"{x}__leaves"))
    return rows.select("doc_id", "n_chars", "edited_sha256", own, new, near(new).alias("near_edited"), near(after).alias("near_next"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS k, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d),
x AS (SELECT doc_id, t, k, after, substring(t, 1, k - k // 2) || substring(after, 1, k // 2) AS edited FROM n),
w AS (SELECT doc_id, 0 AS w, t FROM x UNION ALL SELECT doc_id, 1, edited FROM x UNION ALL SELECT doc_id, 2, after FROM x),
l AS (SELECT doc_id, w, string_split(t, chr(10)) AS ps FROM w),
p AS (SELECT doc_id, w, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS last FROM l),
s AS (SELECT doc_id, w, i, last, p, CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '(?s).{16,96}?(?:[.!?]\x20+|[adgilmouyz,;:]\x20|\z)|.{1,96}') END AS ls FROM p),
h AS (SELECT doc_id, w, i, last, p, list_transform(ls, lambda x: sha256(x)) AS ds FROM s),
g0 AS (SELECT doc_id, w, i, last, p, sha256(array_to_string(ds, '')) AS d, list_transform(ds, lambda x: substring(x, 1, 8)) AS names FROM h),
e AS (SELECT *, (p = '' OR substring(d, 1, 1) IN ('0', '1', '2', '3') OR i = last)::INT AS closes FROM g0),
g AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM e),
c AS (SELECT doc_id, w, sec, sha256(string_agg(d, '' ORDER BY i)) AS dig, string_agg(array_to_string(names, ','), ',' ORDER BY i) AS leaves FROM g GROUP BY 1, 2, 3),
f AS (SELECT doc_id, w, sha256(string_agg(dig, '' ORDER BY sec)) || '/' || string_agg(substring(dig, 1, 16) || '=' || leaves, ';' ORDER BY sec) AS fp FROM c GROUP BY 1, 2),
u AS (SELECT DISTINCT doc_id, w, unnest(names) AS leaf FROM g0),
z AS (SELECT doc_id, w, count(*) AS size FROM u GROUP BY 1, 2),
m AS (SELECT a.doc_id, b.w, count(*) AS both FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.leaf = b.leaf WHERE a.w = 0 AND b.w > 0 GROUP BY 1, 2),
q AS (SELECT x.doc_id, x.k, x.edited, f0.fp AS a, f1.fp AS b,
  CASE WHEN substring(f0.fp, 1, 64) = substring(f1.fp, 1, 64) THEN 1.0 ELSE 2.0::DOUBLE * coalesce(m1.both, 0) / (z0.size + z1.size) END AS near_edited,
  CASE WHEN substring(f0.fp, 1, 64) = substring(f2.fp, 1, 64) THEN 1.0 ELSE 2.0::DOUBLE * coalesce(m2.both, 0) / (z0.size + z2.size) END AS near_next
  FROM x JOIN f f0 ON f0.doc_id = x.doc_id AND f0.w = 0 JOIN f f1 ON f1.doc_id = x.doc_id AND f1.w = 1 JOIN f f2 ON f2.doc_id = x.doc_id AND f2.w = 2
  JOIN z z0 ON z0.doc_id = x.doc_id AND z0.w = 0 JOIN z z1 ON z1.doc_id = x.doc_id AND z1.w = 1 JOIN z z2 ON z2.doc_id = x.doc_id AND z2.w = 2
  LEFT JOIN m m1 ON m1.doc_id = x.doc_id AND m1.w = 1 LEFT JOIN m m2 ON m2.doc_id = x.doc_id AND m2.w = 2)
SELECT doc_id, k AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint, near_edited::DOUBLE AS near_edited, near_next::DOUBLE AS near_next FROM q
"""
