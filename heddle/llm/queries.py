"""The queries of this folder's operators over the driver's tables, each with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, extraction, importance, kdtree, licenses, mixing, neardup, quality, substrings, warc
from heddle.llm.scratch import Scratch
from heddle.session import attach, table

#: The vocabulary file of the tokenizer queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    docs = table(attach(spark), sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    scratch = Scratch(attach(spark), "op2")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    warc.write(warc.with_roles(pages, scratch), scratch.at("archives"))
    scratch.drop("first")
    found = warc.read(spark, scratch.at("archives"), names="part-*")
    # these archives were just written, so a gap is an error
    whole = F.when(F.col("reason").isNull(), F.col("record_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("a gap in"), "archive", F.col("at").cast("string"), "reason")))
    return found.withColumn("record_id", whole).select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names or quotes."""
    docs = table(attach(spark), sf_dir, "documents")
    return licenses.scan(docs, ["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and in which slot of the schedule it does so first."""
    docs = table(attach(spark), sf_dir, "documents").select("doc_id", "source", mixing.sizes().alias("size"))
    mixed = mixing.mix(docs, ["doc_id"], Scratch(spark, "op4"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every vector whose id is divisible by 50."""
    vectors = table(attach(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    found = kdtree.topk(vectors, vectors.where("vec_id % 50 = 0"), Scratch(spark, "op5"), 5)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the verdict on it and what its text is without its host's repeated lines; a document's
    host is its source."""
    docs = table(attach(spark), sf_dir, "documents")
    rated = quality.assess(docs, Scratch(spark, "op6"), ["doc_id"])
    return rated.select("doc_id", *quality.MEASURES, "base_failed", "kept", "removed_words", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 13 words that one with a smaller id has."""
    docs = table(attach(spark), sf_dir, "documents").select("doc_id", "text")
    return substrings.remove(docs, 13).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links of 85 percent on shingles of 3 words."""
    docs = table(attach(spark), sf_dir, "documents").select("doc_id", "text")
    return neardup.link(docs, Scratch(spark, "op8"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn to be like those labelled good and not toxic; as large a share as is labelled good."""
    docs = table(attach(spark), sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    share = labels.agg(F.avg("quality")).first()[0]
    return importance.resample(docs, labels.where("quality = 1 and toxic = 0"), Scratch(spark, "op9"), importance.SHARE if share is None else share)


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    pages = table(attach(spark), sf_dir, "pages").select("page_id", "url", "html", extraction.host().alias("host"))
    found = extraction.wrappers(pages, Scratch(spark, "op10"))
    texts = extraction.extract(pages, found, ["page_id", "url"])
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_warc, op3_licenses, op4_mixing, op5_topk, op6_quality, op7_substrings, op8_neardup, op9_importance, op10_extraction)}


_SEPARATORS = r"[\x20\x09-\x0D]+"
_NEXT = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY k)" for i in range(1, 13))])

def _templates() -> str:
    """Rows (k, q, n, label, exact, share, gram) of the licence templates' grams, in words."""
    rows = []
    for k, t in enumerate(licenses.BASE + licenses.TEXTS):
        w = re.findall("[0-9a-z]+", t.text.lower())
        n = len(w) - licenses.GRAM + 1
        rows += [f"({k}, {q}, {n}, '{t.label}', {t.exact}, {1.0 if t.exact else t.share}::double, '{' '.join(w[q : q + licenses.GRAM])}')" for q in range(n)]
    return ", ".join(rows)


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_EIGHT = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER (PARTITION BY id ORDER BY k)" for i in range(1, quality.WINDOW))])


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SEPARATORS}'), lambda x: x <> '')"


_LABELS = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label)"

_SQL = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) n, sha1(html) h FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) least FROM d)
SELECT page_id, n::bigint AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::integer, 5))::bigint >> (15 - i % 4 * 5)::integer) & 31) + 1)::integer, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM r""",
    "op3_licenses": rf"""WITH l AS (SELECT row_number() OVER () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
t(k, q, n, label, exact, share, gram) AS (VALUES {_templates()}),
u AS (SELECT id, w, unnest(range(len(w) - 2)) p FROM l WHERE len(w) > 2),
m AS (SELECT id, k, n, label, exact, share, q, p - q d FROM u JOIN t ON w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] = gram),
s AS (SELECT *, CASE WHEN NOT exact AND d - lag(d) OVER (PARTITION BY id, k ORDER BY d) <= {licenses.SLACK} THEN 0 ELSE 1 END step FROM (SELECT DISTINCT id, k, exact, d FROM m)),
c AS (SELECT id, k, d, sum(step) OVER (PARTITION BY id, k ORDER BY d) chain FROM s),
v AS (SELECT m.id, m.label, m.exact, m.share, greatest(min(m.d), 0)::bigint start, count(DISTINCT q) / any_value(n) score FROM m JOIN c USING (id, k, d) GROUP BY m.id, m.k, m.label, m.exact, m.share, chain),
f AS (SELECT * FROM v WHERE score >= share)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::bigint AS n_words, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
  {_LABELS} FILTER (exact), '') AS base_labels, {_LABELS}, '') AS labels, coalesce(max(score), 0)::double AS score
FROM l LEFT JOIN f USING (id) GROUP BY id""",
    "op4_mixing": rf"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEPARATORS}'), lambda x: x <> ''))::bigint size FROM documents),
s AS (SELECT source, sum(size)::bigint source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 k, 3.0::double * source_size most FROM s),
w AS (SELECT *, (CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::double weight FROM r),
x AS (SELECT *, (sum(source_size) OVER () - (sum(most) OVER (ORDER BY most / weight, k) - most)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY most / weight, k) + weight) level FROM w),
y AS (SELECT min(level) FILTER (n = 1) level FROM (SELECT level, row_number() OVER (ORDER BY most / weight, k) n FROM x WHERE level * weight <= most)),
g AS (SELECT k, source, source_size, CASE WHEN y.level IS NULL THEN most ELSE least(most, y.level * weight) END target, greatest(1, ceil(sum(source_size) OVER () / {mixing.SLOTS}::double))::bigint tokens FROM x, y),
n AS (SELECT *, least(round(target)::bigint, 3 * source_size) want, (source_size + tokens - 1) // tokens blocks FROM g),
o AS (SELECT *, (want // source_size) * blocks + (want % source_size + tokens - 1) // tokens slots FROM n WHERE want > 0),
c AS (SELECT *, ((sum(slots) OVER (ORDER BY k))::bigint << {mixing.POINT_BITS}) // (sum(slots) OVER ())::bigint till, (((sum(slots) OVER (ORDER BY k))::bigint - slots) << {mixing.POINT_BITS}) // (sum(slots) OVER ())::bigint since FROM o),
t AS (SELECT t, (t * {mixing.PHI}) & {(1 << mixing.POINT_BITS) - 1} u FROM (SELECT unnest(range(0, (SELECT 3 * ({mixing.SLOTS} + {2 * mixing.REPEATS} * (count(*) + 1)) + 1 FROM g))) t)),
a AS (SELECT c.*, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 rank FROM t JOIN c ON u >= since AND u < till),
b AS (SELECT k, t, rank % blocks block, least(tokens, source_size - rank % blocks * tokens) length, greatest(0, least(least(tokens, source_size - rank % blocks * tokens), want - (rank // blocks * source_size + rank % blocks * tokens))) takes FROM a WHERE rank < slots),
m AS (SELECT k, block, count(*) FILTER (takes = length) times, coalesce(max(takes) FILTER (takes < length), 0) rest, coalesce(min(t) FILTER (takes = length), max(t) FILTER (takes < length)) first FROM b GROUP BY k, block),
e AS (SELECT row_number() OVER () id, doc_id, d.source, size, k, source_size, target, tokens, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
l AS (SELECT *, (sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::bigint pos FROM e),
z AS (SELECT id, k, pos, size, tokens, unnest(range(pos // tokens, (pos + size - 1) // tokens + 1)) block FROM l WHERE size > 0),
q AS (SELECT id, first, times * (least(pos + size, (block + 1) * tokens) - greatest(pos, block * tokens)) + greatest(0, least(least(pos + size, (block + 1) * tokens), block * tokens + rest) - greatest(pos, block * tokens)) part FROM z JOIN m USING (k, block)),
v AS (SELECT id, sum(part)::bigint taken, min(first) first_slot FROM q WHERE part > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::bigint AS taken, first_slot FROM e LEFT JOIN v USING (id)""",
    "op5_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v FROM embeddings),
s AS (SELECT a.vec_id query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_quality": rf"""WITH l AS (SELECT row_number() OVER () id, doc_id, source, text, coalesce(text, '') t FROM documents),
d AS (SELECT *, {_words("t")} w, array_to_string({_words(f"translate(t, {_LOWER})")}, ' ') digest, string_split(t, chr(10)) lines FROM l),
u AS (SELECT id, unnest(w) word, generate_subscripts(w, 1) k FROM d),
g AS (SELECT id, k, {_EIGHT} g FROM u),
r AS (SELECT id, k, count(*) OVER (PARTITION BY id, g) n FROM g WHERE g IS NOT NULL),
c AS (SELECT id, count(DISTINCT p) n_repeat_words FROM (SELECT id, unnest(range(k, k + {quality.WINDOW})) p FROM r WHERE n > 1) GROUP BY id),
s AS (SELECT id, source, digest, unnest(lines) line, generate_subscripts(lines, 1) k FROM d),
y AS (SELECT id, source, digest, k, line, array_to_string({_words(f"translate(line, {_LOWER})")}, ' ') norm, len({_words("line")}) n FROM s),
h AS (SELECT source, count(DISTINCT digest) docs FROM d GROUP BY source),
a AS (SELECT source, norm, count(DISTINCT digest) held FROM y WHERE n > 0 GROUP BY source, norm),
b AS (SELECT a.source, norm FROM a JOIN h ON a.source IS NOT DISTINCT FROM h.source WHERE held >= {quality.LINE_DOCS} AND held >= docs * {quality.LINE_SHARE}::double),
z AS (SELECT y.*, b.norm IS NOT NULL gone FROM y LEFT JOIN b ON n > 0 AND y.norm = b.norm AND y.source IS NOT DISTINCT FROM b.source),
q AS (SELECT id, coalesce(sum(n) FILTER (gone), 0)::bigint removed_words, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) n_dup_lines, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') kept_text FROM z GROUP BY id),
m AS (SELECT doc_id, text, kept_text, removed_words, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words FROM d JOIN q USING (id) LEFT JOIN c USING (id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= n_words * {quality.KEPT_SHARE}::double AS kept, removed_words, CASE WHEN text IS NOT NULL THEN sha256(kept_text) END AS kept_sha256 FROM f""",
    "op7_substrings": f"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEPARATORS}'), lambda x: x <> '') w FROM documents),
u AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) k FROM l),
g AS (SELECT doc_id, k, {_NEXT} g FROM u),
f AS (SELECT g, min(doc_id) d FROM g WHERE g IS NOT NULL GROUP BY g),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.k, g.k + 13)) k FROM g JOIN f ON g.g = f.g WHERE f.d < g.doc_id),
m AS (SELECT doc_id, count(*) n FROM c GROUP BY doc_id),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.k = c.k WHERE c.k IS NULL GROUP BY u.doc_id)
SELECT l.doc_id, len(w)::bigint AS n_words, coalesce(m.n, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN m ON m.doc_id = l.doc_id LEFT JOIN t ON t.doc_id = l.doc_id""",
    "op8_neardup": f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}'), lambda x: x <> '') w FROM documents),
u AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) k FROM l WHERE len(w) >= 3),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY k) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY k) s FROM u) WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM l WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id c FROM l UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.doc_id),
k AS (SELECT doc_id, min(c) c FROM r GROUP BY doc_id)
SELECT k.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, k.c AS component_id, k.doc_id = k.c AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose rows it can give in reasonable time at the size at which it is run."""
    return dict(_SQL)
