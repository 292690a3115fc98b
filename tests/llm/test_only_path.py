"""The depth-first path of a part against the relaxed one and against the library's own encoder."""

import random

import numpy as np
import pytest

from volpanel.llm import sentencepiece_fst as S


@pytest.fixture(scope="module")
def machine():
    return S.Transducer(S.read_model())


def test_only_path_is_the_relaxed_path(machine):
    draw = random.Random(3)
    pieces = [p for p in machine.ids if len(p) < 9]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 6))) for _ in range(1500)]
    texts += ["".join(draw.choice("abeinrst▁") for _ in range(draw.randint(1, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 500 + "c"]
    for text in texts:
        assert machine.signs.issuperset(text)
        assert np.array(machine.only_path(text), "<i4").tobytes() == machine.relaxed_path(text) == machine.shortest_path(text)


def test_encode_equals_the_library(machine):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL_FILE)
    draw = random.Random(4)
    signs = "  etaoinshrdlu.,-'\n\t0123é漢\U0001f600▁A"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(1, 80))) for _ in range(400)] + [" ", "  a  b ", "▁x", "�\x00"]
    for text in texts:
        assert np.frombuffer(machine.encode(text), "<i4").tolist() == library.encode(text), text


def test_past_its_first_symbol_the_normaliser_is_one_replacement(machine):
    for state in (S.START, S.BODY):
        for text in ("", " ", "a b", "  a ▁ b  ", "é  "):
            want, at = [], state
            for symbol in text:
                written, _, at = machine.normaliser[at].get(symbol) or machine.normaliser[at][None]
                want += [*written, *([symbol] if symbol != " " else [])]
            assert machine.normalised(text, state) == "".join(want)
