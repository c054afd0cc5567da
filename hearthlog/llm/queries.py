"""The queries of the operators, and the SQL they must equal where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.llm import (
    decontamination,
    fill_in_middle,
    fingerprints,
    licenses,
    lines,
    negatives,
    packing,
    personal_data,
    quality,
    simhash,
    substrings,
    token_counts,
    urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_encoder(path: str | None = None):
    """Maker of the function from text to ids; the default file lies with the workers."""

    def make():
        if path:
            return packing.word_ids(path)
        import public_tokenizers

        return packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))

    return make


@_query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), word_encoder())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op6_decontamination",
    f"""WITH items AS (
      SELECT item_id, regexp_extract_all({_SMALL}, '{_WORDS}') AS words FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, list_slice(words, i, i + least(13, len(words)) - 1) AS window_words
      FROM items, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS t(i) WHERE len(words) > 0),
    texts AS (
      SELECT doc_id, coalesce(regexp_extract_all({_SMALL}, '{_WORDS}'), []) AS words FROM documents),
    places AS (
      SELECT doc_id, i, size, list_slice(words, i, i + size - 1) AS window_words
      FROM texts, (SELECT DISTINCT len(window_words) AS size FROM windows),
           unnest(range(1, len(words) - size + 2)) AS t(i)),
    found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (window_words)),
    hit AS (
      SELECT doc_id, count(DISTINCT word) AS n_hit
      FROM found, unnest(range(i, i + size)) AS t(word) GROUP BY doc_id),
    owners AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_items,
             array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items
      FROM found GROUP BY doc_id),
    terms AS (
      SELECT item, item_id, word, min(i) AS i, count(*) OVER (PARTITION BY item) AS size
      FROM (SELECT row_number() OVER () AS item, item_id, words FROM items WHERE len(words) > 0),
           unnest(words) WITH ORDINALITY AS t(word, i) GROUP BY item, item_id, word),
    spots AS (
      SELECT doc_id, word, i FROM texts, unnest(words) WITH ORDINALITY AS t(word, i)
      WHERE word IN (SELECT word FROM terms)),
    rarest AS (
      SELECT item, item_id, word, size, row_number() OVER (PARTITION BY item ORDER BY n, i) AS place
      FROM terms JOIN (SELECT word, count(*) AS n FROM spots GROUP BY word) USING (word) QUALIFY place <= 4),
    together AS (
      SELECT item, item_id, doc_id, rare.i, any_value(size) AS size, count(DISTINCT near.place) AS n
      FROM rarest AS rare_term JOIN spots AS rare USING (word)
      JOIN (SELECT item, place, doc_id, i FROM rarest JOIN spots USING (word)) AS near USING (item, doc_id)
      WHERE rare_term.place = 1 AND abs(near.i - rare.i) <= 26 GROUP BY item, item_id, doc_id, rare.i),
    neighbours AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_near,
             array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS near
      FROM together WHERE n = least(4, size) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated,
           coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
    FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id) LEFT JOIN neighbours USING (doc_id)""",
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_matches(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return decontamination.contamination(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
        F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_sha256"),
    )


@_query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def _joined(spans: str):
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


@_query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in personal_data.KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


@_query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


@_query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(_table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected, with what they are selected by."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.with_quality(docs, quality.fit_quality(docs, _ratings(spark, sf_dir)))
    return scored.where(F.col("top_chance") >= quality.LEAST_CHANCE).select(
        "doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("top_chance", 9).alias("top_chance")
    )


@_query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents"))


@_query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_strings(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@_query(
    "op11_hard_negatives",
    """WITH points AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
    parts AS (
      SELECT vec_id, label, i, floor(256 * CAST(embedding[i] AS DOUBLE)) AS x, embedding[i] IS NULL OR NOT isfinite(embedding[i]) AS bad
      FROM points, unnest(range(1, len(embedding) + 1)) AS t(i)),
    sound AS (SELECT * EXCLUDE (bad) FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE bad)),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM sound a JOIN sound b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
    positives AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER hardest AS INTEGER) AS rank, id AS negative_id,
           positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW hardest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY rank <= 10""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(points.withColumn("label", moved), F.col("id") % 100 == 0)


@_query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


@_query(
    "op13_fill_in_middle",
    r"""WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
    lined AS (
      SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || digest[1:8] AS BIGINT) AS h1,
             CAST('0x' || digest[9:16] AS BIGINT) AS h2, CAST('0x' || digest[17:24] AS BIGINT) AS h3,
             CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM texts),
    cuts AS (
      SELECT doc_id, text, lines, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
             greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lined),
    parts AS (
      SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS prefix,
             array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM parts""",
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
