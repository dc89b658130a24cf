"""Registered queries of the subpackage: ``QUERIES[name] = (builder, oracle SQL or None)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunk_reuse, embedding_dedup, importance, language, license_scan, packing, periodic_runs, prefix_trie, search, simhash, subword_sampling, token_files, warc

QUERIES: dict = {}

# Noise of the importance sampling, a quarter of the standard one: the choice stays close to the weights.
TEMPERATURE = 0.25


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_files")
def op1_token_files(spark, sf_dir):
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@register("op2_topk_search")
def op2_topk_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"), k=10)


@register("op3_sampled_segmentations")
def op3_sampled_segmentations(spark, sf_dir):
    return subword_sampling.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), k=3)


@register("op4_embedding_components")
def op4_embedding_components(spark, sf_dir):
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"), least=0.95)


@register("op5_simhash_components")
def op5_simhash_components(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, limit=2)


@register("op6_importance_resampling")
def op6_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), temperature=TEMPERATURE)


@register("op7_warc_revisits")
def op7_warc_revisits(spark, sf_dir):
    _, records = warc.deduplicate(table(spark, sf_dir, "pages"), "page_id", "url", "html", least=0)
    return records.withColumnRenamed("id", "page_id")


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


def _license_sql() -> str:
    names = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in license_scan.TEMPLATES)
    edge = license_scan.EDGE.replace("'", "''")
    words = lambda x: rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '[\x09-\x0D\x20]+'), lambda v: trim(v, '{edge}')), lambda v: v <> '')"
    shingles = "CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END"
    return f"""WITH t AS (SELECT template, list_distinct({shingles}) AS shingles
          FROM (SELECT template, {words('body')} AS w FROM (VALUES {names}) v(template, body))),
        d AS (SELECT doc_id, {shingles} AS x FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents)),
        p AS (SELECT doc_id, template, len(shingles) AS n_shingles, len(list_intersect(shingles, x)) AS n_found,
          list_filter(range(len(x)), lambda i: list_contains(shingles, x[i + 1])) AS hits FROM d, t WHERE list_has_any(x, shingles))
        SELECT DISTINCT doc_id, template, n_shingles, n_found, n_found / n_shingles AS containment,
          list_min(hits) AS first_word, list_max(hits) + 4 AS last_word FROM p WHERE n_found / n_shingles >= 0.8"""


@register("op9_license_scan", _license_sql())
def op9_license_scan(spark, sf_dir):
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


@register("op10_language_evidence")
def op10_language_evidence(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    c = language.page_columns()
    page = pages.select("page_id", c["text"].alias("page_text"), c["declared"].alias("said"), c["host"].alias("site"), c["suffix"].alias("ending"))
    return language.identify(page, language.fit(docs), "page_id", "page_text", *[page[x] for x in ("said", "site", "ending")])


@register("op11_chunk_reuse")
def op11_chunk_reuse(spark, sf_dir):
    return id_digests(chunk_reuse.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def id_digests(encoded):
    """Digest columns of ``encode_and_decode``."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def with_repeated_tails(docs):
    """(doc_id, text): where crc32 of the decimal doc_id is a multiple of 10, the words from
    word a on become repeats of the first p of them; other texts stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return run_digests(periodic_runs.periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


def run_digests(found):
    """Digest columns of ``periodic_runs``; the run of most periods, the first of several."""
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    more = F.aggregate("runs", none, lambda x, r: F.when(r.length * x.period > x.length * r.period, r).otherwise(x))
    best = found.select("*", F.when(F.size("runs") > 0, more).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def shared_heads(turns, convs):
    """Every conversation c begins with the first h turns of conversation c - c % 5 (all if
    fewer, none if absent) and goes on with its own after its first h; h is crc32 of the
    decimal c modulo 9. ``convs`` keeps conversations left without turns."""
    c = F.col("conv")
    plan = convs.select("conv", F.col("n").alias("own"), (F.crc32(c.cast("string")) % 9).alias("h"), (c - c % 5).alias("base"))
    counts = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(counts, "base", "left").select("*", F.least("h", F.coalesce("base_n", F.lit(0))).alias("given"))
    said = ["said", "other", "size"]
    heads = turns.where("pos < 8").withColumnRenamed("conv", "base").join(plan, "base").where("pos < h").select("conv", "pos", *said)
    tails = turns.join(plan, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), *said)
    left = F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.union(tails), plan.select("conv", left.alias("n"))


def trie_rows(trie):
    """Digest columns of ``prefix_trie``."""
    found = trie.nodes.join(prefix_trie.ends_digests(trie.ends), ["node1", "node2"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.select(*columns, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


@register("op13_prefix_trie")
def op13_prefix_trie(spark, sf_dir):
    turns, convs = shared_heads(*prefix_trie.conversation_turns(table(spark, sf_dir, "conversations")))
    return trie_rows(prefix_trie.prefix_trie(turns, convs))
