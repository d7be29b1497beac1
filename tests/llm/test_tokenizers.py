"""Packing takes byte-level tokenizers only and says so."""

import json

import public_tokenizers
import pytest

from vigil.llm import packing


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}])
def test_other_tokenizers_are_refused(tmp_path, change):
    file = tmp_path / "t.json"
    file.write_text(json.dumps(json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read()) | change))
    with pytest.raises(ValueError):
        packing.WordEncoder(str(file))


def test_added_tokens_that_strip_are_refused(tmp_path):
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        packing.WordEncoder(str(tmp_path / "t.json"))
