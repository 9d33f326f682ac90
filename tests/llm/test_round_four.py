"""Where the tokenizer's objects are made, and the recurrent steps against the plain loop they stand for."""

import os

import numpy as np
import pyarrow as pa
import pytest

from labelweave.llm import bpe, langmodel


def test_tokenizer_objects_are_made_in_tasks_only(docs_of, monkeypatch):
    """The driver kept most of their memory for all later stages."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    driver, make = os.getpid(), bpe.Vocabulary.tokenizer

    def tokenizer(self):
        assert os.getpid() != driver, "made on the driver"
        return make(self)

    monkeypatch.setattr(bpe.Vocabulary, "tokenizer", tokenizer)
    rows = [(1, "a b <|endoftext|> c"), (2, None), (3, "b b"), (4, ""), (None, "b b")]
    out = bpe.encode_decode(docs_of(rows), public_tokenizers.path("byte_bpe_50k.json"), 3).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in out) == [(0, "b b"), (1, "a b <|endoftext|> c"), (2, ""), (3, "b b"), (4, "")]


def test_word_list_spells_listed_words():
    listed = pa.table({"word": pa.chunked_array([["the", "of"], ["é"]]), "ids": pa.chunked_array([[[5], [6, 7]], [[]]], pa.list_(pa.int32()))})
    words = bpe.WordList(listed)
    codes = words.numbers(pa.array(["of", "new", "é", "the"]))
    assert codes.tolist() == [1, 3, 2, 0]
    ids, counts = words.spell(codes, [np.array([9, 8], np.uint32)])
    assert (ids.tolist(), counts.tolist()) == ([6, 7, 9, 8, 5], [2, 2, 0, 1])
    none = bpe.WordList(listed.slice(0, 0))
    assert none.numbers(pa.array(["of"])).tolist() == [0]


def _plain_run(model, state, inputs, fresh):
    """The recurrent steps with all gates side by side in one row."""
    h, states, xs = model.cfg.hidden, [], model.x[inputs]
    for t in range(len(inputs)):
        prev = state * (1 - fresh[t])[:, None]
        rec = prev @ model.u
        zr = 0.5 * (1 + np.tanh(0.5 * (xs[t, :, : 2 * h] + rec[:, : 2 * h])))
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(xs[t, :, 2 * h :] + r * rec[:, 2 * h :])
        state = new + z * (prev - new)
        states.append(state)
    return np.stack(states), state


def test_recurrent_steps_equal_the_plain_loop():
    cfg, words = langmodel.LmConfig(), langmodel.Words.__new__(langmodel.Words)
    words.head, words.deep = cfg.head, 0
    rng = np.random.default_rng(6)
    size = (cfg.head + 2) * 48 + 16 * 48 + 16 * 25 + 25 + 16 * cfg.head + cfg.head
    model = langmodel.Gru(words, cfg, rng.normal(0, 0.3, size))
    for lanes in (1, 7, 256):
        inputs, fresh = rng.integers(0, cfg.head + 2, (cfg.window, lanes)), (rng.random((cfg.window, lanes)) < 0.05).astype(np.float32)
        start = rng.normal(0, 0.5, (lanes, cfg.hidden)).astype(np.float32)
        given = start.copy()
        for a, b in zip(model.run(start, inputs, fresh), _plain_run(model, start, inputs, fresh)):
            np.testing.assert_array_equal(a, b)
        np.testing.assert_array_equal(start, given)


def test_gradient_is_one_array_of_the_model():
    cfg, words = langmodel.LmConfig(head=5, classes=3, hidden=4), langmodel.Words.__new__(langmodel.Words)
    words.head, words.class_of, words.first = 5, np.array([0, 1, 1, 2, 2]), np.array([0, 1, 3, 5])
    model = langmodel.Gru(words, cfg, np.arange(7 * 12 + 4 * 12 + 16 + 4 + 20 + 5))
    assert np.shares_memory(model.parts_of(model.flat)["ww"], model.ww)
    one = np.concatenate([part.ravel() for part in model.parts_of(model.flat).values()])
    np.testing.assert_array_equal(one, model.flat)
    model.flat[:] = np.random.default_rng(3).normal(0, 0.3, len(one))
    _, _, grad = model.window(np.zeros((1, 4), np.float32), np.array([[6], [2]]), np.array([[1], [0]], np.float32), np.array([[2], [4]]), np.ones((2, 1), bool), True)
    touched = np.flatnonzero(np.abs(model.parts_of(grad)["x"]).sum(1))
    assert touched.tolist() == [2, 6] and grad.shape == model.flat.shape


def test_order_of_numbers_is_stable_at_any_width():
    keys = np.random.default_rng(8).integers(0, 50, 5000)
    for below in (50, 1 << 15, (1 << 15) + 1):
        np.testing.assert_array_equal(langmodel.sorted_order(keys, below), np.argsort(keys, kind="stable"))
    assert langmodel.sorted_order(np.array([40_000, 1]), 40_001).tolist() == [1, 0]
