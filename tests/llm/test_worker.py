"""A worker gives back what one operator kept when the next one begins."""

import weakref

import pandas as pd
import public_tokenizers
import pytest

from vigil.llm import neardup, packing, toxicity, worker

BPE = public_tokenizers.path("byte_bpe_50k.json")
STARTS = {
    "sketches": lambda: neardup._sketches.func(iter([pd.Series(["a b"])])),
    "sets": lambda: neardup._sets(iter([pd.DataFrame({"node": [1], "text": ["a b"]})])),
    "examples": lambda: toxicity._examples(iter([pd.DataFrame({"shard": [0], "id": [1], "y": [0], "text": ["a b"]})])),
}


@pytest.mark.parametrize("name", STARTS)
def test_the_encoder_goes_when_another_operator_begins(name):
    worker.begin("packing")
    encoder = worker.kept(f"encoder {BPE}", lambda: packing.WordEncoder(BPE))
    worker.begin("packing")  # the next task of the same operator
    assert worker.kept(f"encoder {BPE}", lambda: None) is encoder
    left = weakref.ref(encoder)
    del encoder
    assert len(list(STARTS[name]())) == 1
    assert left() is None
