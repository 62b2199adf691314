"""The registered queries of this subpackage: each applies one operator to its whole table. SQL gives the same rows in DuckDB where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The model of op1 and of the pipeline's last stage; a file that the driver reads and sends on.
def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Per document: how many ids, their checksum, and a digest of the text decoded from them."""
    from .pieces import decode_pieces, encode_pieces

    model = model or piece_model()
    back = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model, keep=["doc_id"]), model)
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.crc32(F.concat_ws(",", F.col("piece_ids").cast("array<string>"))).alias("ids_crc32"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def held_out(doc_id: str = "doc_id"):
    """The fold that language identification never learns from; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_field(docs: DataFrame):
    from .language import train_field

    return train_field(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, language_field(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "second_score", "n_words")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_near_dups

    found = simhash_near_dups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have a source and a language, taken as host and as section of the host. Labels of the fold that is held out are not learned from."""
    from .quality import score_quality, train_classifier

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, train_classifier(docs, labels.where(~held_out())), F.col("source"), F.col("lang"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids, read the files back, and give each document's place, length and checksum."""
    import public_tokenizers

    from .common import scratch_path
    from .token_files import read_documents, write_tokens

    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    folder = scratch_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), folder, text, end_id=1)
    return read_documents(spark, files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that holds benchmark items."""
    from .decontaminate import benchmark_hits

    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    held = F.col("benchmark_hits")
    return found.where(F.size(held) > 0).select("doc_id", F.size(held).alias("n_items"), F.transform(held, lambda h: h["item_id"]).alias("item_ids"), F.array_max(F.transform(held, lambda h: h["share"])).alias("best_share"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a checksum of doc_id, the words from one on go round with a period. Of a null doc_id nothing changes."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # a column of its own, so that words are cut once
    cut_up = docs.select("doc_id", "text", g.alias("g"), words.alias("w")).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rounds = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    turned = F.concat(F.slice("w", 1, F.col("a")), F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), rounds)))
    return cut_up.withColumn("p", period).select("doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(turned, 1, F.col("n")), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many runs, the longest, and digests of all runs and of the text without their repetitions."""
    from .runs import periodic_runs

    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")), keep=["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), listed.alias("listed"), "collapsed")
    start, length, period = -F.col("m.early"), F.col("m.length"), -F.col("m.short")
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), digest("listed").alias("runs_sha256"), digest("collapsed").alias("collapsed_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document, its checksum, and where it stands in which sequence."""
    import public_tokenizers

    from .packing import best_fit, token_pieces

    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    pieces = token_pieces(table(spark, sf_dir, "documents"), text, end_id=1)
    # the ids themselves aren't written: only their checksums are asked for
    placed = best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), ["doc_id", "piece", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, a stated few of them with one letter left out. Of a null doc_id none is changed."""
    from .spelling import count_words, letter_runs, spelling_groups

    # what is left of a changed run is one shorter, so shorter runs never matter
    runs = letter_runs(table(spark, sf_dir, "documents"), least=6)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.char_length("run")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(F.coalesce(h % 199 == 0, F.lit(False)), without).otherwise(F.col("run")).alias("word"))
    return spelling_groups(count_words(words, least=6, occurrences=5), times=5)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_line_dedup, op4_license_scan, op5_simhash, op6_quality, op7_token_files, op8_decontaminate, op9_nearest, op10_substring_dedup, op11_periodic_runs, op12_best_fit_packing, op13_spelling_variants)}

SQL: dict[str, str] = {
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d),
w AS (SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win FROM p),
f AS (SELECT win, min(row(doc_id, p)) AS first FROM w GROUP BY win HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.p FROM w JOIN f USING (win) WHERE row(w.doc_id, w.p) <> f.first),
g AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT doc_id, p + unnest([0, 1, 2]) AS line FROM c) GROUP BY doc_id),
k AS (SELECT doc_id, i, l FROM (SELECT doc_id, unnest(lines) AS l, unnest(range(1, len(lines) + 1)) AS i FROM d) LEFT JOIN g USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, i)),
t AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.kept, '') END AS text, coalesce(len(d.lines), 0) AS n_lines, coalesce(len(g.gone), 0) AS n_removed
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_nearest": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda e: e[1] * e[2])) / (q.n * c.n) AS score
FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, p + unnest(range(0, 35)) AS q FROM r) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))),
lambda a, b: xor(a // 256, t.t[xor(a, b) % 256 + 1])), 4294967295) AS h FROM r, t),
m AS (SELECT CASE WHEN coalesce(h % 199 = 0, false) THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
b AS (SELECT word, count(*) AS n_near, min(row(-m, other)) AS best FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root, form FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.form)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.form IS NULL
""",
}
