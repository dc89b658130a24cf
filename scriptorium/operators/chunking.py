"""Token-bounded chunking of documents.

Everything happens inside the document row with higher-order array functions, so
chunking is map-only (no shuffle); only the optional global running number needs one
range shuffle (see ``operators.numbering``).

Semantics: units are the stripped, non-blank sentences of the cleaned text. A unit above
``max_tokens`` is split into greedy word groups (a single word above the limit stays
whole). Parts are packed greedily in order: a new chunk opens when ``cur + n > max`` and
the current chunk is not empty, so an oversize part sits alone. Parts are joined with
``\\n`` and the estimate is the sum of the part counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import cut

PART_TYPE = "struct<text:string,n:int>"
SPAN_TYPE = "array<struct<s:int,len:int,tok:int>>"


# Token counters given by the user: an expression whose counts add up over words, or a
# function of a batch of texts (a model's tokenizer) whose counts need not.
Counter = Callable[[Column], Column]
BatchCounter = Callable[[list[str]], list[int]]
# A sentence model given by the user: the sentences of each of a batch of paragraphs.
Segmenter = Callable[[list[str]], list[list[str]]]


def word_counts(texts: list[str]) -> list[int]:
    """The default counter, for batches of texts."""
    return [len(t.split()) for t in texts]


def segmented(segmenter: Segmenter, texts: list[str]) -> list[list[str]]:
    """The sentences of each text. If the call raises, texts are tried one by one, and one
    whose own call raises is its only sentence."""

    def called(some: list[str]) -> list[list[str]]:
        got = [list(x) for x in segmenter(some)]
        if len(got) != len(some):
            raise ValueError("segmenter returned a different number of texts")
        return got

    try:
        return called(texts) if texts else []
    except Exception:
        out = []
        for t in texts:
            try:
                out += called([t])
            except Exception:
                out.append([t])
        return out


def with_units_by(df: DataFrame, paragraphs_col: str, segmenter: Segmenter, out_col: str = "_units") -> DataFrame:
    """Replaces the paragraphs by their sentences, stripped, without blank ones; the sentence
    model is called on the executors, once for the paragraphs of some documents of a batch
    (see ``functions.batches``)."""
    keep = [f for f in df.schema.fields if f.name != paragraphs_col]
    names = [f.name for f in keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)

    def run(batches):
        for b in (x for whole in batches for x in cut(whole, paragraphs_col)):
            docs = [p or [] for p in b[paragraphs_col].to_pylist()]
            sentences = iter(segmented(segmenter, [p for d in docs for p in d]))
            units = [[s.strip() for _ in d for s in next(sentences) if s.strip()] for d in docs]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(units, pa.list_(pa.string()))], names=[*names, out_col])

    return df.mapInArrow(run, f"{schema}`{out_col}` array<string>")


def count_units(units: Column) -> Column:
    """ARRAY<STRING> -> ARRAY<STRUCT<text, nw>> with each unit's word count (one pass)."""
    return F.transform(units, lambda u: F.struct(u.alias("text"), T.count_words(u).alias("nw")))


def split_oversize_by(units: Column, max_tokens: int, counter: Counter, per_unit_overhead: int = 0) -> Column:
    """``split_oversize`` with an additive counter of the user's: units above the limit become
    greedy groups of their words by the words' own counts (a word above it stays alone)."""
    o = F.lit(per_unit_overhead)

    def per_unit(u: Column) -> Column:
        n = (counter(u) + o).cast("int")
        words = F.transform(T.py_split(u), lambda w: F.struct(w.alias("text"), counter(w).cast("int").alias("n")))
        groups = F.flatten(
            F.transform(
                F.array(words),
                lambda ws: F.transform(
                    pack_spans(ws, max(max_tokens - per_unit_overhead, 1)),
                    lambda c: F.struct(
                        F.array_join(F.transform(F.slice(ws, c["s"] + 1, c["len"]), lambda x: x["text"]), " ").alias("text"),
                        (c["tok"] + o).cast("int").alias("n"),
                    ),
                ),
            )
        )
        return F.when(n <= max_tokens, F.array(F.struct(u.alias("text"), n.alias("n")))).otherwise(groups)

    return F.filter(F.flatten(F.transform(units, per_unit)), lambda p: p["n"] > 0)


def words_that_fit(words: list[str], max_tokens: int, counter: BatchCounter, monotone: bool) -> list[tuple[str, int]]:
    """Greedy groups of words, each joined by spaces and counted as joined. ``monotone``
    says that a longer group never counts less: group ends are then found by doubling and
    halving instead of word by word."""
    out, at = [], 0
    while at < len(words):
        alone = counter([words[at]])[0]
        if alone > max_tokens:
            out.append((words[at], alone))
            at += 1
            continue
        if monotone:
            low, high = 1, 2  # low words fit
            while at + high <= len(words) and counter([" ".join(words[at : at + high])])[0] <= max_tokens:
                low, high = high, 2 * high
            high = min(high, len(words) - at + 1)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if counter([" ".join(words[at : at + mid])])[0] <= max_tokens else (low, mid)
            n = low
        else:
            n = 1
            while at + n < len(words) and counter([" ".join(words[at : at + n + 1])])[0] <= max_tokens:
                n += 1
        text = " ".join(words[at : at + n])
        out.append((text, counter([text])[0]))
        at += n
    return out


def with_parts_by(
    df: DataFrame, units_col: str, max_tokens: int, counter: BatchCounter, monotone: bool = True, out_col: str = "_parts", segmenter: Segmenter | None = None
) -> DataFrame:
    """Replaces the units by their parts (text, n) with a counter that is called on batches
    of texts on the executors, e.g. a tokenizer: once for the units of some documents of a
    batch (see ``functions.batches``), then for the words of units above the limit. With a sentence model such a unit is cut
    into its sentences first (not stripped), and only those above the limit into words."""
    keep = [f for f in df.schema.fields if f.name != units_col]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches):
        for b in (x for whole in batches for x in cut(whole, units_col)):
            docs = [u or [] for u in b[units_col].to_pylist()]
            counts = iter(counter([u for d in docs for u in d]) if any(docs) else [])
            parts = []
            for units in docs:
                mine = []
                for u in units:
                    n = int(next(counts))
                    if n <= max_tokens:
                        mine.append((u, n))
                        continue
                    whole = [u] if segmenter is None else [x for x in segmented(segmenter, [u])[0] if x.strip()]
                    for x, size in zip(whole, counter(whole) if segmenter else [n], strict=True):
                        mine += [(x, size)] if size <= max_tokens else words_that_fit(x.split(), max_tokens, counter, monotone)
                parts.append([{"text": t, "n": int(n)} for t, n in mine if n > 0])
            made = pa.array(parts, pa.list_(pa.struct([("text", pa.string()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), made], names=[*names, out_col])

    return df.mapInArrow(run, f"{schema}, `{out_col}` array<{PART_TYPE}>")


def split_oversize_counted(counted: Column, max_tokens: int, per_unit_overhead: int = 0) -> Column:
    """Counted units -> ARRAY<STRUCT<text, n>> parts that fit ``max_tokens``.

    With the additive word counter, greedy word packing of an oversize unit is exactly
    "consecutive groups of ``max_tokens - overhead`` words" (at least one word each); the
    word array is built only for oversize units.
    """
    g = max(max_tokens - per_unit_overhead, 1)
    o = F.lit(per_unit_overhead)

    def per_unit(x: Column) -> Column:
        u, nw = x["text"], x["nw"]
        n = nw + o
        # The outer one-element transform binds the word array, so it is built once and not
        # for every group.
        groups = F.flatten(
            F.transform(
                F.array(T.py_split(u)),
                lambda ws: F.transform(
                    F.sequence(F.lit(0), F.ceil(nw / F.lit(g)).cast("int") - 1),
                    lambda i: F.struct(
                        F.array_join(F.slice(ws, i * g + 1, F.lit(g)), " ").alias("text"),
                        (F.least(F.lit(g), nw - i * g) + o).cast("int").alias("n"),
                    ),
                ),
            )
        )
        whole = F.array(F.struct(u.alias("text"), n.cast("int").alias("n")))
        return (
            F.when(n <= max_tokens, whole)
            .when(nw > 0, groups)
            .otherwise(F.array().cast(f"array<{PART_TYPE}>"))
        )

    parts = F.flatten(F.transform(counted, per_unit))
    return F.filter(parts, lambda p: p["n"] > 0)


def split_oversize(units: Column, max_tokens: int, per_unit_overhead: int = 0) -> Column:
    """ARRAY<STRING> units -> ARRAY<STRUCT<text, n>> parts that fit ``max_tokens``."""
    return split_oversize_counted(count_units(units), max_tokens, per_unit_overhead)


def pack_spans(parts: Column, max_tokens: int) -> Column:
    """Greedy order-preserving packing as a fold: ARRAY<STRUCT<text,n>> ->
    ARRAY<STRUCT<s,len,tok>> (0-based start, number of parts, token sum) per chunk.

    The fold state keeps the open chunk as scalars and appends to the output array only
    at a chunk boundary, so copying is proportional to the chunk count.
    """
    init = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("cur"),
        F.lit(0).alias("s"),
        F.lit(0).alias("len"),
        F.array().cast(SPAN_TYPE).alias("out"),
    )

    def step(acc: Column, p: Column) -> Column:
        brk = (acc["cur"] + p["n"] > F.lit(max_tokens)) & (acc["len"] > 0)
        closed = F.array_append(
            acc["out"], F.struct(acc["s"].alias("s"), acc["len"].alias("len"), acc["cur"].alias("tok"))
        )
        return F.when(
            brk,
            F.struct(
                (acc["i"] + 1).alias("i"),
                p["n"].alias("cur"),
                acc["i"].alias("s"),
                F.lit(1).alias("len"),
                closed.alias("out"),
            ),
        ).otherwise(
            F.struct(
                (acc["i"] + 1).alias("i"),
                (acc["cur"] + p["n"]).alias("cur"),
                acc["s"].alias("s"),
                (acc["len"] + 1).alias("len"),
                acc["out"].alias("out"),
            )
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["s"].alias("s"), acc["len"].alias("len"), acc["cur"].alias("tok"))
        return F.when(acc["len"] > 0, F.array_append(acc["out"], last)).otherwise(acc["out"])

    return F.aggregate(parts, init, step, finish)


def chunk_structs(parts: Column, spans: Column) -> Column:
    """Parts + spans -> ARRAY<STRUCT<seq, text, token_count_estimate>> (seq from 1).

    ``parts`` and ``spans`` should be materialised columns: a lambda re-evaluates any
    expression it references, so passing the expression trees here would recompute the
    whole split per chunk."""
    return F.transform(
        spans,
        lambda c, k: F.struct(
            (k + 1).alias("seq"),
            F.array_join(F.transform(F.slice(parts, c["s"] + 1, c["len"]), lambda x: x["text"]), "\n").alias(
                "text"
            ),
            c["tok"].alias("token_count_estimate"),
        ),
    )


def with_chunk_array(
    df: DataFrame,
    max_tokens: int,
    text_col: str = "text",
    out_col: str = "chunks",
    per_unit_overhead: int = 0,
    clean: bool = True,
    counter: Counter | None = None,
    batch_counter: BatchCounter | None = None,
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """Adds ``out_col`` = the document's chunk array, in staged projections (units ->
    parts -> spans -> chunks) so that each intermediate array is computed once per row."""
    body = T.clean_text(F.col(text_col)) if clean else F.col(text_col)
    keep = [c for c in df.columns if c != text_col]
    if segmenter is not None:
        units = with_units_by(df.select(*keep, T.split_paragraphs(body).alias("_paragraphs")), "_paragraphs", segmenter)
    elif counter is None and batch_counter is None:
        units = df.select(*keep, count_units(T.semantic_units(body)).alias("_units"))
    else:
        units = df.select(*keep, T.semantic_units(body).alias("_units"))
    if batch_counter is not None or (segmenter is not None and counter is None):
        count = batch_counter or (lambda texts: [n + per_unit_overhead for n in word_counts(texts)])
        parts = with_parts_by(units, "_units", max_tokens, count, segmenter=segmenter)
    elif counter is not None:
        parts = units.select(*keep, split_oversize_by(F.col("_units"), max_tokens, counter, per_unit_overhead).alias("_parts"))
    else:
        parts = units.select(*keep, split_oversize_counted(F.col("_units"), max_tokens, per_unit_overhead).alias("_parts"))
    staged = parts.select(*keep, "_parts", pack_spans(F.col("_parts"), max_tokens).alias("_spans"))
    return staged.select(*keep, chunk_structs(F.col("_parts"), F.col("_spans")).alias(out_col))


def chunk_documents(
    df: DataFrame,
    max_tokens: int = 2048,
    text_col: str = "text",
    doc_col: str = "source_document",
    per_unit_overhead: int = 0,
    clean: bool = True,
    spread: bool = True,
    counter: Counter | None = None,
    batch_counter: BatchCounter | None = None,
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """One row per chunk: ``doc_col, seq, text, token_count_estimate``. Map-only.

    Tokens are whitespace words unless a ``counter`` (an additive expression) or a
    ``batch_counter`` (a function of texts, e.g. a tokenizer) is given; the latter counts
    whole texts, so it adds special tokens itself. Sentences are those of the rules unless a
    ``segmenter`` (a sentence model) is given. ``spread=False`` keeps the input's partitioning (required when the caller numbers
    chunks per range partition)."""
    from ..session import ensure_parallelism

    src = df.select(doc_col, text_col)
    src = ensure_parallelism(src) if spread else src
    arr = with_chunk_array(src, max_tokens, text_col, "_chunks", per_unit_overhead, clean, counter, batch_counter, segmenter)
    # explode_outer + filter instead of explode: the optimizer would otherwise infer a
    # "size(chunks) > 0" filter below the projections and evaluate the whole split twice.
    exploded = arr.select(F.col(doc_col), F.explode_outer("_chunks").alias("_c")).where(F.col("_c").isNotNull())
    return exploded.select(doc_col, "_c.*")


def stable_chunk_id(doc_col: str = "source_document", seq_col: str = "seq") -> Column:
    """Resume key that does not depend on file order: ``<document>#<seq>``."""
    return F.concat_ws("#", F.col(doc_col).cast("string"), F.col(seq_col).cast("string"))


def chunk_stats(
    df: DataFrame, max_tokens: int = 2048, text_col: str = "text", per_unit_overhead: int = 0
) -> DataFrame:
    """Run counters of the chunking job: files, chunks, oversize units, largest chunk.

    One global aggregate with map-side partial aggregation (a single row is shuffled
    per task)."""
    from ..session import ensure_parallelism

    src = ensure_parallelism(df.select(text_col))
    units = src.select(count_units(T.semantic_units(T.clean_text(F.col(text_col)))).alias("u"))
    per_doc = units.select(
        F.size(F.filter(F.col("u"), lambda x: x["nw"] + F.lit(per_unit_overhead) > max_tokens)).alias("n_over"),
        split_oversize_counted(F.col("u"), max_tokens, per_unit_overhead).alias("parts"),
    ).select("n_over", pack_spans(F.col("parts"), max_tokens).alias("spans"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("files_found"),
        F.sum(F.size("spans")).cast("long").alias("chunks_written"),
        F.sum("n_over").cast("long").alias("oversize_units"),
        F.max(F.array_max(F.transform("spans", lambda c: c["tok"]))).alias("max_chunk_tokens"),
    )


def chunk_corpus(
    docs: DataFrame,
    max_tokens: int = 2048,
    text_col: str = "text",
    doc_col: str = "source_document",
    per_unit_overhead: int = 0,
    running_ids: bool = True,
    num_partitions: int | None = None,
    counter: Counter | None = None,
    batch_counter: BatchCounter | None = None,
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """Documents -> chunk rows ``text, source_document, chunk_id, token_count_estimate``.

    ``running_ids=True`` gives ``chunk_<n>`` numbered over all documents in
    ``source_document`` order, then chunk order (one range shuffle of the documents,
    whose sampling pass reads only the document key). ``False`` gives the stable
    ``<document>#<seq>`` id with no shuffle at all.
    """
    from .numbering import number_ranged, range_partition

    if running_ids:
        ranged = range_partition(docs.select(doc_col, text_col), [doc_col], num_partitions)
        chunks = chunk_documents(ranged, max_tokens, text_col, doc_col, per_unit_overhead, spread=False, counter=counter, batch_counter=batch_counter, segmenter=segmenter)
        numbered = number_ranged(chunks, [doc_col, "seq"], "_n")
        cid = F.concat(F.lit("chunk_"), F.col("_n").cast("string"))
        out = numbered.withColumn("chunk_id", cid)
    else:
        chunks = chunk_documents(docs, max_tokens, text_col, doc_col, per_unit_overhead, counter=counter, batch_counter=batch_counter, segmenter=segmenter)
        out = chunks.withColumn("chunk_id", stable_chunk_id(doc_col))
    return out.select(
        "text", F.col(doc_col).alias("source_document"), "chunk_id", F.col("token_count_estimate").cast("int")
    )
