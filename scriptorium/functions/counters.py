"""Token counters of a model's tokenizer, for ``operators.chunking``."""

from __future__ import annotations

from collections.abc import Callable

_LOADED: dict[str, object] = {}
TEXTS_TOGETHER = 1000


def tokenizer_counter(path: str, add_special_tokens: bool = True) -> Callable[[list[str]], list[int]]:
    """Counts of the tokenizer in a file of the ``tokenizers`` library. The file is loaded
    once per worker, so ``path`` must name it on every machine."""

    def count(texts: list[str]) -> list[int]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _LOADED:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
        # An encoding holds far more than the ids, so few texts are encoded at a time.
        some = (texts[i : i + TEXTS_TOGETHER] for i in range(0, len(texts), TEXTS_TOGETHER))
        return [len(e.ids) for ts in some for e in _LOADED[path].encode_batch(ts, add_special_tokens=add_special_tokens)]

    return count
