"""The queries ``opN_<name>`` of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ship_package

from . import alignment, byte_bpe, chat, embedding_dedup, licenses, line_dedup, merkle, near_dedup, outliers, packing, pages, substring_dedup, unigram_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.planted(spark)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_chat_format, op3_substring_dedup, op4_byte_bpe, op5_minhash_near_dedup, op6_packing, op7_embedding_near_dedup, op8_line_dedup, op9_token_counts, op10_quality_rules, op11_html_extraction, op12_cross_tokenizer_alignment, op13_merkle_manifest)
    return {f.__name__: f for f in found}


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Smallest node that links (a, b; both ways) reach from each node of ``nodes``, as a common table expression.
_REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"


def _escaped(column: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({column}, '\', '\\'), '<(/?s>)', '<\\;\1', 'g'), '\[(/?INST\])', '[\\;\1', 'g')"


_CHAT = f"""WITH said AS (SELECT '</s>[INST] ok [/INST]' AS said),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', said FROM said UNION ALL SELECT -7, 1, 'assistant', said FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars FROM rows GROUP BY conv_id"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id AND x.m > 0 AND y.m > 0 WHERE list_dot_product(x.e, y.e) / (x.m * y.m) >= 0.93), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
c AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = id AS kept FROM comp LEFT JOIN c ON c.a = id"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM l), o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.*, owner IS NULL OR owner = doc_id AS stays FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM f GROUP BY doc_id"""

#: CRC-32 of a text, bit by bit: its bytes enter the register at every eighth step.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda r, b: xor(xor(r, b) >> 1, 3988292384::UBIGINT * (xor(r, b) & 1))), 4294967295::UBIGINT)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree_sql(name: str, levels: int) -> str:
    """Levels ``name``0 (g, pos, digest, n: nodes of g) to ``name````levels``, each with the siblings of its nodes before and behind; a last node stays as it is."""
    out = []
    for k in range(levels):
        run = f"(PARTITION BY g, pos // {merkle.RUN} ORDER BY pos ROWS BETWEEN "
        out.append(f"{name}s{k} AS (SELECT *, CASE WHEN n = 1 THEN NULL ELSE coalesce(string_agg(digest, '') OVER {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a, CASE WHEN n = 1 THEN NULL ELSE coalesce(string_agg(digest, '') OVER {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, pos // {merkle.RUN} AS pos, CASE WHEN min(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (min(n) + {merkle.RUN - 1}) // {merkle.RUN} AS n FROM {name}s{k} GROUP BY g, pos // {merkle.RUN})")
    return ", ".join(out)


def _merkle_sql(levels: int = 5, top: int = 3) -> str:
    """Trees of up to 16 ** ``levels`` leaves a source, over up to 16 ** ``top`` sources."""
    siblings = ", ".join([f"s{k}.a AS a{k}, s{k}.b AS b{k}" for k in range(levels)] + [f"r{k}.a AS c{k}, r{k}.b AS d{k}" for k in range(top)])
    joins = " ".join([f"JOIN ts{k} s{k} ON s{k}.g = l.g AND s{k}.pos = l.pos // {merkle.RUN**k}" for k in range(1, levels)] + [f"JOIN us{k} r{k} ON r{k}.pos = o.pos // {merkle.RUN**k}" for k in range(top)])
    steps = [(f"a{k}", f"b{k}") for k in range(levels)] + [(f"c{k}", f"d{k}") for k in range(top)]
    folds, of = [], "f0"
    for k, (a, b) in enumerate(steps):
        folds.append(f"g{k} AS (SELECT *, CASE WHEN {a} IS NULL THEN f{k} ELSE sha256({a} || f{k} || {b}) END AS f{k + 1} FROM {of if k == 0 else f'g{k - 1}'})")
    proof = " || ".join(f"coalesce({a} || {b}, '')" for a, b in steps)
    return f"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_leaf_sql('text')} AS digest, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(f'translate(text, {_LOWER})')} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d), t0 AS (SELECT g, pos, digest, n FROM l), {_tree_sql('t', levels)},
o AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t{levels}), u0 AS (SELECT 0 AS g, pos, digest, n FROM o), {_tree_sql('u', top)},
f0 AS (SELECT l.doc_id, l.digest AS leaf, o.digest AS subroot, coalesce(l.tampered, l.digest) AS f0, {siblings} FROM l JOIN o ON o.g = l.g JOIN ts0 s0 ON s0.g = l.g AND s0.pos = l.pos {joins}), {', '.join(folds)}
SELECT doc_id, leaf, subroot, u.digest AS root, sha256({proof}) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = u.digest AS verified FROM g{len(steps) - 1}, u{top} u"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _CHAT, "op5_minhash_near_dedup": _NEAR, "op7_embedding_near_dedup": _VECTORS, "op8_line_dedup": _LINES, "op13_merkle_manifest": _merkle_sql()}
