"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op01_bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), byte_bpe())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op03_token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), byte_bpe())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op06_ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op07_suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op10_token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op08_warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op05_html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op04_mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op09_quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), whole=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitempo.llm.op02_decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op2_decontaminate, op9_quality, op4_topk, op5_html, op8_warc, op1_bpe, op3_token_files, op6_ngram_join, op7_suffix_dedup, op10_token_counts)}

#: Words of op2: runs of letters and digits in lower case; of op6: runs of bytes that are no blanks, A-Z in lower case.
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _runs(words: str, k: str) -> str:
    """The runs of k words of a list; with fewer words, none."""
    return f"list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string(list_slice({words}, i, i + {k} - 1), ' '))"


def _shingles(words: str) -> str:
    return f"CASE WHEN len({words}) >= 5 THEN {_runs(words, '5')} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""WITH w AS (SELECT DISTINCT doc_id, {_WORDS} AS words FROM documents),
      it AS (SELECT item_id, words, len(words) AS n, least(5, len(words)) AS k FROM (SELECT DISTINCT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
      ig AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS off, unnest({_runs('words', 'k')}) AS gram FROM it),
      dg AS (SELECT doc_id, words, k, unnest(range(0, len(words) - k + 1)) AS pos, unnest({_runs('words', 'k')}) AS gram FROM w, (SELECT DISTINCT k FROM it) WHERE len(words) >= k),
      h AS (SELECT DISTINCT doc_id, words, item_id, n, greatest(0, least(pos - off, len(words) - n)) AS start FROM dg JOIN ig USING (k, gram)),
      x AS (SELECT doc_id, item_id, start, list_slice(words, start + 1, start + n) AS part FROM h),
      ws AS (SELECT doc_id, item_id, start, s, count(*) AS c FROM (SELECT doc_id, item_id, start, unnest({_shingles('part')}) AS s FROM x) GROUP BY ALL),
      si AS (SELECT item_id, s, count(*) AS c FROM (SELECT item_id, unnest({_shingles('words')}) AS s FROM it) GROUP BY ALL),
      b AS (SELECT doc_id, item_id, start, sum(least(ws.c, si.c)) AS shared FROM ws JOIN si USING (item_id, s) GROUP BY ALL),
      t AS (SELECT b.*, shared / CAST(greatest(len(part) - 4, 1) + greatest(n - 4, 1) - shared AS DOUBLE) AS similarity FROM b JOIN x USING (doc_id, item_id, start) JOIN it USING (item_id))
      SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM t WHERE similarity >= 0.8) WHERE r = 1""",
    "op4_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_ngram_join": f"""WITH RECURSIVE s AS (SELECT doc_id, list_distinct({_shingles('words')}) AS own FROM (SELECT doc_id, {_RUNS} AS words FROM documents)),
      u AS (SELECT doc_id, unnest(own) AS g FROM s),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * shared >= 80 * (len(x.own) + len(y.own) - shared)),
      c AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
      SELECT s.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM c GROUP BY 1) m USING (doc_id)""",
    "op7_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      g AS (SELECT doc_id, pos, substring(h, 2 * pos + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS pos FROM d)),
      f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY w) AS first FROM g) WHERE first < doc_id),
      o AS (SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) + 50 AS opens FROM f),
      r AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o) GROUP BY doc_id, run),
      k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY 1),
      t AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, coalesce(2 * y, len(h)) - 2 * x), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1),
      n AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM r GROUP BY 1)
      SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
      s AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
      b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM s)
      SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substring(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substring(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substring(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substring(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substring(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
}
