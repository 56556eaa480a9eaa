"""Units of the tokenizer against the library, on units and texts made to be told apart hardly."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from metrosift.llm.segments import first_of_each  # noqa: E402
from metrosift.llm.token_counts import TOKENIZER, Encoder, tokenizer_path  # noqa: E402


def _differing(texts: list[str]) -> list[str]:
    from tokenizers import Tokenizer

    path = tokenizer_path(TOKENIZER)
    library = Tokenizer.from_file(path)
    ids, sizes = Encoder(path).encode(pa.array(texts))
    ends, counts = np.cumsum(sizes), Encoder(path).count(pa.array(texts))
    assert counts.tolist() == sizes.tolist()
    return [t for t, n, e in zip(texts, sizes, ends) if ids[e - n:e].tolist() != library.encode(t, add_special_tokens=False).ids]


def test_new_units_with_the_same_first_eight_bytes():
    rng = random.Random(1)
    words = [" internal", " internat", " interns", "internet", "internals", "internal"]
    words += [" abcdefg" + "".join(rng.choice("hijkl") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    assert _differing(words) == []
    assert _differing(["".join(words)]) == []


def test_first_of_each_takes_all_columns_together():
    a, b = np.array([1, 1, 2, 1, 2], np.uint64), np.array([5, 6, 5, 5, 5], np.uint64)
    assert first_of_each(a, b).tolist() == [0, 1, 2]
    assert first_of_each(a).tolist() == [0, 2]
    assert first_of_each(a[:0], b[:0]).tolist() == []
