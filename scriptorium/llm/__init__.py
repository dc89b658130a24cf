"""Operations of a training-data pipeline: tokenised binary output, exact top-k search,
subword sampling, near-duplicate detection over embeddings and fingerprints, importance
resampling, WARC revisits, sequence packing, license scans and language identification.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it
is present."""
