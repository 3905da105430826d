"""The corpus operators as named queries over a dataset folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lanegraph.llm import decontamination, exact_search, host_reputation, merkle, near_dedup, packing, phrases, pu_quality, quality_rules, sentence_dedup, suffix_dedup, toxicity, warc
from lanegraph.llm.common import ascii_lower
from lanegraph.stage import fresh_path
from lanegraph.tables import table


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every byte of every document that lies in a repeated string of 400 bytes goes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix_dedup.deduplicate(docs, keep="none", whole_characters=False)
    return found.select(
        "doc_id", "n_bytes", suffix_dedup.n_removed().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of every document's near duplicates."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).withColumnRenamed("id", "doc_id")


_OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN k ON node = doc_id LEFT JOIN n USING (doc_id)
"""


def op3_sentence_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document that lies in a run of three sentences found before goes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = sentence_dedup.deduplicate(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", "n_sentences", "n_cut", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept_text")).alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
    '(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D].*?(?:[.!?]["''”’»)\]]*[\x20\x09-\x0D]+|[。！？]["''”’»)\]]*[\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*|\z)') AS s
  FROM documents),
w AS (
  SELECT doc_id, i, list_transform(s[i:i + 2], lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS g
  FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE k > 1),
k AS (
  SELECT doc_id, string_agg(x, '' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS p FROM t) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
o AS (
  SELECT doc_id, text, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(s) - coalesce(n, 0) AS BIGINT) AS n_cut,
    CASE WHEN len(s) = 0 THEN text ELSE coalesce(kept, '') END AS kept
  FROM t LEFT JOIN k USING (doc_id))
SELECT doc_id, n_sentences, n_cut, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
  CAST(octet_length(encode(text)) - octet_length(encode(kept)) AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256
FROM o
"""


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page into WARC archives and back."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    warc.write(warc.plan_records(pages), path)
    return warc.read(spark, path).select(
        warc.key_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"),
    )


_OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


def _remainder(base: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % base


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; every fifth is held out of training."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(_remainder(5) != 0)
    scored = toxicity.toxicity(docs, labels)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; every third is held out of training."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality").filter(_remainder(3) != 1)
    scored = pu_quality.quality(docs, labels)
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, tokenized and packed into sequences of 2048 ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule ledger of every document under the policy web/1."""
    book = quality_rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(book, "web/1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("base/1"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


_OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^\pL]+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_marks
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 1000000)::INT
    + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT + 32 * (10 * n_symbols > n_words)::INT
    + 64 * (100 * n_dup_lines > 60 * n_lines)::INT + 128 * (100 * n_letters < 60 * word_chars)::INT
    + 256 * (100 * n_upper > 50 * n_letters)::INT + 512 * (100 * n_marks > 30 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits
FROM b
"""


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every ten-word window of the benchmark."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        decontamination.digest().alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT *, least(10, len(w)) AS l FROM iw WHERE len(w) > 0))),
ls AS (SELECT DISTINCT l FROM ig),
dg AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, ls WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, l, i FROM dg JOIN ig USING (l, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and host reputation over every page; labels.quality = 0 is a bad outcome."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("long").alias("bad"))
    return host_reputation.filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


_OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (
  SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM p LEFT JOIN o USING (page_id) WHERE host <> '' GROUP BY host),
g AS (
  SELECT *, regexp_extract(bare, '([^.]*\.)?[^.]*$') AS two, regexp_extract(bare, '([^.]*\.)?([^.]*\.)?[^.]*$') AS three FROM h),
d AS (
  SELECT host, n, bad,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','com.mx','co.za') THEN three ELSE two END AS domain,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','com.mx','co.za') THEN two
      ELSE regexp_extract(bare, '[^.]*$') END AS suffix FROM g),
x AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad) / sum(n) AS rate, sum(bad * bad / n) AS q, sum(n::DOUBLE * n) AS nn, sum(bad)::DOUBLE AS b
  FROM h WHERE n > 0),
y AS (
  SELECT *, (q - n * rate * rate) / (k - 1) AS btw, (b - q) / (n - k) AS wit, (n - nn / n) / (k - 1) AS size FROM x),
z AS (
  SELECT rate, least(greatest(CASE WHEN btw + (size - 1) * wit > 0 THEN (btw - wit) / (btw + (size - 1) * wit) ELSE 0 END, 0.001), 0.5) AS rho FROM y),
pr AS (SELECT rate, (1 - rho) / rho AS kappa FROM z),
dd AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM d GROUP BY ALL),
ss AS (SELECT suffix, (sum(dbad) + kappa * rate) / (sum(dn) + kappa) AS s_mean FROM dd, pr GROUP BY suffix, kappa, rate),
dm AS (SELECT domain, (dbad + kappa * s_mean) / (dn + kappa) AS d_mean FROM dd JOIN ss USING (suffix), pr),
hm AS (SELECT host, n, kappa, (bad + kappa * d_mean) / (n + kappa) AS mean FROM d JOIN dm USING (domain), pr),
v AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + kappa + 1)) > 0.5 AS bad FROM hm),
r AS (
  SELECT p.*, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, coalesce(r.host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN v.bad THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN v ON r.host = v.host
"""

_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof, and the root that it gives after every third has been tampered with."""
    docs = table(spark, folder, "documents").select(*_LEAF)
    harmed = merkle.leaf_of(*[ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in _LEAF])
    docs = docs.withColumn("harmed", F.when(_remainder(3) == 0, F.unhex(harmed)))
    rows = merkle.manifest(docs, _LEAF, carry=("harmed",))
    given = F.coalesce(F.lower(F.hex("harmed")), F.col("leaf"))
    proof = F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), merkle.folded(given, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op11_sql(most: int = 7) -> str:
    """Level by level up to 8**``most`` leaves a language, and as many languages."""
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(f) if f != "text" else field("text").replace("|| text::", f"|| {text}::") for f in _LEAF) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"f AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS given FROM documents)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f)",
        "t0 AS (SELECT lang AS g, pos, count(*) OVER (PARTITION BY lang) AS c, leaf AS d FROM x)",
    ]

    def levels(t: str, s: str) -> None:
        for k in range(most + 1):
            if k:
                parts.append(f"{t}{k} AS (SELECT g, pos // 8 AS pos, (c + 7) // 8 AS c, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {t}{k - 1} WHERE c > 1 GROUP BY g, pos // 8, c)")
            parts.append(f"{s}{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {t}{k} a JOIN {t}{k} b ON a.g IS NOT DISTINCT FROM b.g AND a.pos // 8 = b.pos // 8 WHERE a.c > 1 GROUP BY a.g, a.pos)")

    levels("t", "s")
    ends = lambda t: " UNION ALL ".join(f"SELECT g, d FROM {t}{k} WHERE c = 1" for k in range(most + 1))
    parts.append(f"subs AS ({ends('t')})")
    parts.append("gs AS (SELECT g AS lang, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS gpos FROM subs)")
    parts.append("u0 AS (SELECT 0 AS g, gpos AS pos, count(*) OVER () AS c, subroot AS d FROM gs)")
    levels("u", "v")
    parts.append(f"root AS ({ends('u')})")
    parts.append("w0 AS (SELECT doc_id, x.lang, pos, gpos, leaf, subroot, leaf AS a, given AS b, '' AS p FROM x JOIN gs ON x.lang IS NOT DISTINCT FROM gs.lang)")
    for k in range(2 * most + 2):
        name, j, at, g = ("s", k, "pos", "w.lang") if k <= most else ("v", k - most - 1, "gpos", "0")
        fold = lambda c: f"CASE WHEN y.pos IS NULL THEN {c} ELSE sha256(l || {c} || r) END AS {c}"
        parts.append(f"w{k + 1} AS (SELECT doc_id, lang, w.pos, gpos, leaf, subroot, {fold('a')}, {fold('b')}, p || coalesce(l || r, '') AS p FROM w{k} w LEFT JOIN {name}{j} y ON y.g IS NOT DISTINCT FROM {g} AND y.pos = w.{at} // {8**j})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root.d AS root, sha256(p) AS proof_sha256, b AS folded_root, b = root.d AS verified FROM w{2 * most + 2}, root"


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"))


_OP12_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (
  SELECT lang, g, count(*)::BIGINT AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM p, range(1, 6) AS ks(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
u AS (
  SELECT lang, g, f AS a, k, g[1:k] AS x, g[k + 1:] AS y FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c)),
s AS (
  SELECT u.lang, u.g, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM u JOIN c l ON l.lang = u.lang AND l.g = x JOIN c r ON r.lang = u.lang AND r.g = y JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (
  SELECT lang, g[x:x + k - 1] AS g, max(f) AS f
  FROM (SELECT *, unnest(range(2, len(g) - x + 2)) AS k FROM (SELECT *, unnest(range(1, len(g))) AS x FROM c WHERE len(g) > 2)) WHERE k < len(g) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE i.f IS NULL OR i.f < a),
o AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty vectors of highest inner product for every twentieth vector, against all."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = exact_search.search(rows, F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


_OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    return corpus_pipeline.run(spark, folder)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_sentence_dedup": op3_sentence_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_pu_quality": op9_pu_quality,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrases": op12_phrases,
    "op13_exact_search": op13_exact_search,
    "pipeline": pipeline,
}

_SQL = {"op2_near_dedup": _OP2_SQL, "op3_sentence_dedup": _OP3_SQL, "op4_warc": _OP4_SQL, "op7_quality_rules": _OP7_SQL, "op8_decontamination": _OP8_SQL, "op10_url_filter": _OP10_SQL}
_SQL |= {"op11_merkle_manifest": _op11_sql(), "op12_phrases": _OP12_SQL, "op13_exact_search": _OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
