"""Registered queries of the operators: one per operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ownerscope.llm import (exact_dedup, jaccard_join, language_model, licenses, manifest, packing, quality, resampling, sentencepieces,
                            simhash, suffix_dedup, token_file, toxicity)
from ownerscope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(modulus: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(5) != 0))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = sentencepieces.decode(sentencepieces.encode(docs)).withColumnRenamed("text", "decoded")
    # the digest of what comes back, next to that of the text, tells whether the round trip is exact
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_file.new_folder(spark)
    token_file.write_file(table(spark, sf_dir, "documents"), folder)
    return token_file.read_file(spark, folder)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "posterior")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.manifest(docs, found=manifest.without_line_ends(docs))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_sentencepiece, op3_license_scan, op4_token_file, op5_exact_dedup, op6_suffix_dedup,
    op7_quality_rules, op8_packing, op9_jaccard_join, op10_lm_scoring, op11_simhash, op12_resampling, op13_manifest)}

#: crc32 of strings: ``t`` is the table of the 256 bytes, built by eight shifts of each.
_CRC_TABLE = """crc_step as (select i::bigint as i, i::bigint as c, 0 as k from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_step where k < 8),
crc_table as (select list(c order by i) as t from crc_step where k = 8)"""


def _crc(column: str) -> str:
    """Over a table joined with crc_table."""
    code = f"list_transform(range(0, len(hex({column})) // 2), lambda i: ('0x' || substr(hex({column}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {code}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLES: dict[str, str] = {
    "op12_resampling": f"""
        with recursive {_CRC_TABLE},
        x as (select 0 as side, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
          union all select 1, item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
        f as (select side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from x),
        b as (select f, {_crc('f')} % 10000 as b from (select distinct f from f) y, crc_table),
        fb as (select side, doc_id, b from f join b using (f)),
        c as (select r.i as b, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from range(10000) r(i) left join fb on fb.b = r.i group by r.i),
        g as (select b, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from c),
        d as (select doc_id, count(*) as n, sum(gain) as total from fb join g using (b) where side = 0 group by doc_id),
        e as (select x.doc_id, len(w) >= 20 as fit, coalesce(n, 0) as n_features, coalesce(floor(total::double / n), 0)::bigint as weight,
          floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || x.doc_id), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as noise
          from x left join d on d.doc_id = x.doc_id where side = 0),
        k as (select *, row_number() over (partition by fit order by weight + noise desc, doc_id) as r, 25 * count(*) over (partition by fit) // 100 as most from e)
        select doc_id, n_features, weight, weight + noise as score, case when fit and r <= most then r end as rank from k""",
    "op13_manifest": f"""
        with recursive {_CRC_TABLE},
        l as (select doc_id, source, leaf, found, row_number() over (partition by source order by doc_id, leaf) - 1 as pos, count(*) over (partition by source) as n from
          (select doc_id, source, {_leaf('text')} as leaf, case when {_crc('doc_id::varchar')} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end as found
           from documents, crc_table) y),
        up as (select source, 0 as level, pos, leaf as node, n from l
          union all select source, level + 1, pos // 3, sha256(string_agg(node, '' order by pos)), (n + 2) // 3 from up where n > 1 group by source, level, pos // 3, n),
        subroots as (select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
        top as (select 0 as level, pos, subroot as node, n from subroots
          union all select level + 1, pos // 3, sha256(string_agg(node, '' order by pos)), (n + 2) // 3 from top where n > 1 group by level, pos // 3, n),
        runs as (select source, level, pos // 3 as run, list(node order by pos) as nodes from up where n > 1 group by source, level, pos // 3),
        way as (select source, doc_id, leaf, 0 as level, pos, n, '' as proof, found as node from l
          union all select w.source, doc_id, leaf, w.level + 1, pos // 3, (n + 2) // 3,
            proof || array_to_string(nodes[1:pos % 3], '') || array_to_string(nodes[pos % 3 + 2:], ''),
            sha256(array_to_string(nodes[1:pos % 3], '') || w.node || array_to_string(nodes[pos % 3 + 2:], ''))
          from way w join runs r on r.source is not distinct from w.source and r.level = w.level and r.run = w.pos // 3 where n > 1),
        top_runs as (select level, pos // 3 as run, list(node order by pos) as nodes from top where n > 1 group by level, pos // 3),
        way_up as (select doc_id, leaf, subroot, 0 as level, s.pos, s.n, proof, node from way w join subroots s on s.source is not distinct from w.source where w.n = 1
          union all select doc_id, leaf, subroot, w.level + 1, pos // 3, (n + 2) // 3,
            proof || array_to_string(nodes[1:pos % 3], '') || array_to_string(nodes[pos % 3 + 2:], ''),
            sha256(array_to_string(nodes[1:pos % 3], '') || w.node || array_to_string(nodes[pos % 3 + 2:], ''))
          from way_up w join top_runs r on r.level = w.level and r.run = w.pos // 3 where n > 1)
        select doc_id, leaf, subroot, top.node as root, sha256(proof) as proof_sha256, way_up.node as folded_root, way_up.node = top.node as verified
        from way_up, top where way_up.n = 1 and top.n = 1""",
    "op5_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
                   from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from d""",
}
