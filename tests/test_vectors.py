import hashlib

import numpy as np

from veinstone.functions.vectors import _embedded, feature_hash, feature_hashes


def test_feature_hash_slots_and_signs():
    wanted = np.zeros(32)
    for feature in ["alpha", "b-2", "翠湖", "湖授", "alpha", "单"]:
        raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        wanted[raw % 32] += 1 if raw >> 10 & 1 else -1
    got = feature_hash("Alpha B-2 翠湖授 ALPHA, 单", 32)
    assert np.allclose(got, wanted / np.linalg.norm(wanted))


def test_text_without_features_is_zero():
    assert not feature_hash("...", 8).any()


def test_vectors_counted_together_are_those_of_single_texts():
    texts = ["", "river stone", "River-stone river x1", "翠湖授信 abc", "翠", "a b c d a", "?!"] * 60
    together = feature_hashes(texts, 16)
    assert all((together[i] == feature_hash(t, 16)).all() for i, t in enumerate(texts))
    listed = _embedded([None, *texts, None, ""], 16).to_pylist()
    assert listed[0] is None and listed[-2] is None and listed[-1] == [0.0] * 16
    assert listed[1:-2] == together.astype("float32").tolist()
    assert _embedded([], 16).to_pylist() == [] and _embedded([None], 16).to_pylist() == [None]
