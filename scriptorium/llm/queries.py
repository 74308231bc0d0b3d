"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, merkle, near_dup, packing, pii, quality, quotes, reputation, secrets, sharding, token_files, web_text, whitening
from scriptorium.llm.common import ascii_lower, materialize, new_path, table

#: The key of the sample queries; a real one comes from a secret store.
KEY = "sample-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), KEY, "n_entities").select("doc_id", "text", "n_entities")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_text.extract(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.components(table(spark, sf_dir, "documents"), near_dup.Near(shingle=2))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.number(F.col("strong"), k).alias(f"n_{k}") for k in secrets.STRONG]
    return found.select("doc_id", *counts, F.sha2(secrets.written(F.col("strong")), 256).alias("base_sha256"), secrets.written(F.concat("strong", "linked")).alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.POLICIES[1])) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (quality.passes() & ~base).alias("kept")
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and rejects alone."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents"))).select("rule", "n_failed", "n_only_this")


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


#: The id behind each document in the token files.
END_TOKEN = 2
#: (verdict, host/path) of the sample query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # a page shows the document whose number is in its path, so that document's label is the page's outcome
    shown = pages.select("page_id", F.try_to_number(F.regexp_extract("url", r"://[^/?#]*/\w+/(\d{1,18})", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.greatest("toxic", 1 - F.col("quality")).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select("page_id", "bad")
    return reputation.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards under the law `bytes`: a stored map of 39 shards is rebalanced to one more, and the next version read back."""
    rows = materialize(sharding.records(table(spark, sf_dir, "documents")), "shard-records")
    heavy = sharding.heavy_ids(rows)
    rows = materialize(sharding.slotted(rows, heavy), "shard-slots")
    path = new_path(spark, "shard-map")
    sharding.store(sharding.slot_map(rows, 39, heavy), spark, path)
    sharding.store(sharding.rebalance(sharding.stored(spark, path), 40), spark, path)
    placed = sharding.assign(rows, sharding.stored(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op11_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a new folder hold, read back from them."""
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_TOKEN)
    return token_files.read(spark, path, ("doc_id", "start", "n_tokens", "ids_crc32"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof, and what it gives for a copy of the table in which a third of the texts has changed."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    told = merkle.leaf([changed if f == "text" else F.col(f) for f in merkle.FIELDS])
    manifest = merkle.build(table(spark, sf_dir, "documents"), kept={"doc_id": F.col("doc_id"), "told": told})
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    found = merkle.proofs(manifest).withColumn("folded_root", merkle.folded_root(F.col("told")))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot")]
    return found.select("doc_id", *hexed, root.alias("root"), merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_site_templates": op3_site_templates,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_multipart_secrets": op5_multipart_secrets,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality_rules": op7_quality_rules,
        "op8_quotation_linking": op8_quotation_linking,
        "op9_host_reputation": op9_host_reputation,
        "op10_sharding": op10_sharding,
        "op11_packed_token_files": op11_packed_token_files,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_embedding_whitening": op13_embedding_whitening,
        "quality_ablation": quality_ablation,
    }


#: The smallest document number that a component reaches, by walking its links; shingles of two words.
_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE [ws[i], ws[i + 1]] END AS g FROM w, range(1, greatest(len(ws), 2)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
walk AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON walk.seen = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM walk GROUP BY doc_id) c USING (doc_id)
"""

_LEAKS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g FROM b, range(1, len(ws) - least(len(ws), 10) + 2) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM w, sizes, range(1, len(ws) - n + 2) AS r(i)),
hits AS (SELECT doc_id, item_id, i, grams.n FROM grams JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) AS r(k) WHERE k < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, range(1, len(ws) - 1) AS r(i)),
often AS (SELECT doc_id, a, b, c FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN often USING (doc_id, a, b, c), range(3) AS s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""


#: When a document of the measurements m fails each rule.
_RULES_SQL = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


def _ablation_sql() -> str:
    failed = " + ".join(f"({c})::INT" for c in _RULES_SQL.values())
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({c}) AS n_failed, count(*) FILTER (({c}) AND fails = 1) AS n_only_this FROM f" for r, c in _RULES_SQL.items())
    return _QUALITY_SQL[: _QUALITY_SQL.rindex("SELECT doc_id")].rstrip() + f", f AS (SELECT *, {failed} AS fails FROM m) {each}"


def _strength_sql(children: str) -> str:
    return f"""
    SELECT CASE WHEN known < 2 THEN {reputation.WEAKEST} WHEN coalesce(w, 0) = 0 OR s <= e THEN {reputation.STRONGEST} ELSE least({reputation.STRONGEST}, greatest({reputation.WEAKEST}, w / (s - e) - 1)) END AS found
    FROM (SELECT count(*) AS known, sum(pow(bad - n * m, 2)) AS s, sum(n * m * (1 - m)) AS e, sum(n * m * (1 - m) * (n - 1)) AS w FROM {children} WHERE n > 1 AND m > 0 AND m < 1)
    """


def _shrunk_sql(children: str, keys: str) -> str:
    """keys, the posterior mean m and its size backed."""
    return f"SELECT {keys}, (m * k + bad) / (k + n) AS m, k + n AS backed FROM (SELECT *, greatest({reputation.WEAKEST}, least(found, backed)) AS k FROM {children}, ({_strength_sql(children)}))"


def _suffix_sql() -> str:
    """The number of labels of the suffix of the labels l."""
    rules = sorted(reputation.SUFFIX_RULES)
    listed = lambda found: "(" + ", ".join(f"'{r}'" for r in found) + ")"
    plain, any_label = listed(r for r in rules if r[0] not in "*!"), listed(r[2:] for r in rules if r[0] == "*")
    exceptions = listed(r[1:] for r in rules if r[0] == "!")
    deepest = max(r.count(".") + 1 for r in rules)
    last = lambda k: f"array_to_string(l[-{k}:], '.')"
    whens = [f"WHEN len(l) >= {k} AND {last(k)} IN {exceptions} THEN {k - 1}" for k in range(deepest, 1, -1)]
    whens += [f"WHEN len(l) >= {k} AND ({last(k)} IN {plain} OR {last(k - 1)} IN {any_label}) THEN {k}" for k in range(deepest, 1, -1)]
    return "CASE " + " ".join(whens) + " ELSE 1 END"


def _rule_sql() -> tuple[str, str]:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        at, _, below = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{below}')"

    return tuple("CASE " + " ".join(f"WHEN {fits(r)} THEN '{x}'" for v, r in ordered for x in [(r, v)[k]]) + " END" for k in (0, 1))


def _reputation_sql() -> str:
    rule, verdict = _rule_sql()
    return rf"""
    WITH after AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
    p AS (
      SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, TRY_CAST(regexp_extract(url, '://[^/?#]*/\w+/(\d{{1,18}})', 1) AS BIGINT) AS shown
      FROM after),
    labelled AS (SELECT p.*, greatest(l.toxic, 1 - l.quality) AS bad FROM p LEFT JOIN labels l ON l.doc_id = p.shown),
    hosts AS (
      SELECT host, regexp_replace(host, '{reputation.OUTSIDE}', '', 'g') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM labelled GROUP BY host),
    labels AS (SELECT *, string_split(name, '.') AS l FROM hosts),
    cut AS (SELECT *, {_suffix_sql()} AS k FROM labels),
    levels AS (
      SELECT *, CASE WHEN regexp_matches(name, '{reputation.ADDRESS}') THEN '{reputation.ADDRESSES}' ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix,
        CASE WHEN regexp_matches(name, '{reputation.ADDRESS}') THEN name ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain FROM cut),
    top AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hosts) AS m, (SELECT sum(n) FROM hosts) AS backed FROM levels GROUP BY suffix),
    top_rate AS ({_shrunk_sql("top", "suffix")}),
    middle AS (SELECT domain, d.n, d.bad, t.m, t.backed FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM levels GROUP BY ALL) d JOIN top_rate t USING (suffix)),
    middle_rate AS ({_shrunk_sql("middle", "domain")}),
    low AS (SELECT host, levels.n, levels.bad, m, backed FROM levels JOIN middle_rate USING (domain)),
    rate AS ({_shrunk_sql("low", "host")})
    SELECT page_id, host, path, {rule} AS rule,
      coalesce({verdict}, CASE WHEN m - {reputation.Z} * sqrt(m * (1 - m) / (backed + 1)) > {reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN rate USING (host)
    """


#: The checksum of a number's digits (it is at most twenty bytes long), bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _merkle_sql() -> str:
    fields = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
    climb = """
      SELECT doc_id, l.tree, p.level + 1, p.index // 8, sha256(string_agg(CASE WHEN l.index = p.index THEN p.own ELSE l.h END, '' ORDER BY l.index)),
        any_value(p.found) || coalesce(string_agg(l.h, '' ORDER BY l.index) FILTER (l.index <> p.index), '')
      FROM {path} p JOIN nodes l ON l.tree = p.tree AND l.level = p.level AND l.index // 8 = p.index // 8 WHERE l.n > 1 GROUP BY doc_id, l.tree, p.level, p.index, p.own"""
    last = "(SELECT * FROM {path} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)"
    return f"""
    WITH RECURSIVE changed AS (SELECT *, CASE WHEN {_CRC_SQL} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
    leaves AS (
      SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS index, count(*) OVER (PARTITION BY lang) AS n,
        sha256({fields} || {_field_sql("text")}) AS h, sha256({fields} || {_field_sql("other")}) AS told
      FROM changed),
    below AS (
      SELECT tree, 0 AS level, index, h, n FROM leaves
      UNION ALL SELECT tree, level + 1, index // 8, sha256(string_agg(h, '' ORDER BY index)), any_value((n + 7) // 8) FROM below WHERE n > 1 GROUP BY tree, level, index // 8),
    subroots AS (SELECT tree, h FROM below WHERE n = 1),
    above AS (
      SELECT -1 AS tree, 0 AS level, tree AS index, h, (SELECT count(*) FROM subroots) AS n FROM subroots
      UNION ALL SELECT tree, level + 1, index // 8, sha256(string_agg(h, '' ORDER BY index)), any_value((n + 7) // 8) FROM above WHERE n > 1 GROUP BY tree, level, index // 8),
    nodes AS (SELECT * FROM below UNION ALL SELECT * FROM above),
    path AS (SELECT doc_id, tree, 0 AS level, index, told AS own, '' AS found FROM leaves UNION ALL {climb.format(path="path")}),
    top_path AS (SELECT doc_id, -1 AS tree, 0 AS level, tree AS index, own, found FROM {last.format(path="path")} UNION ALL {climb.format(path="top_path")})
    SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, root.h AS root, sha256(found) AS proof_sha256, own AS folded_root, own = root.h AS verified
    FROM leaves JOIN subroots USING (tree) JOIN {last.format(path="top_path")} t USING (doc_id) CROSS JOIN (SELECT h FROM above WHERE n = 1) root
    """


def oracle_sql() -> dict[str, str]:
    """Surrogates, packings, page trees, nested quotes, slot maps, linked spans, token files and eigenvectors have no SQL form here; their tests stand in tests/llm."""
    return {
        "op4_minhash_near_dedup": _NEAR_SQL,
        "op6_decontaminate": _LEAKS_SQL,
        "op7_quality_rules": _QUALITY_SQL,
        "op9_host_reputation": _reputation_sql(),
        "op12_merkle_manifest": _merkle_sql(),
        "quality_ablation": _ablation_sql(),
    }
