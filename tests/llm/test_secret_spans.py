"""Spans of the field that go beyond a base span, and its decoding of all tokens."""

import numpy as np

from volpanel.llm import secrets

# A field that begins a secret at each token of 8 characters or more, and nowhere else.
ALL = {"weights": np.zeros((sum(secrets.CODES), 3), np.float32), "moves": np.array([[0, 0, secrets.NEVER], [0, 0, 0], [0, 0, 0]], float)}
ALL["weights"][:2, secrets.OUTSIDE] = ALL["weights"][2 : secrets.CODES[0], secrets.BEGIN] = 1.0


def shown(text):
    return secrets.redacted(text, secrets.scan_texts(ALL, [text])[1][0])


def test_what_goes_beyond_a_base_span_is_redacted():
    assert shown("password = Sup3rSecretPw9@Kx72Lq") == "[secret]"
    assert shown("a ZZ0123456789abcdef0123QQ b") == "a [secret] b"
    base, every = secrets.scan_texts(ALL, ["password = Sup3rSecretPw9"])
    assert base == every  # nothing beyond it: no span of the field


def test_covered():
    spans = [("hex", 2, 6), ("assign", 4, 9)]
    assert secrets.covered(3, 9, spans) and not secrets.covered(1, 5, spans) and not secrets.covered(3, 10, spans) and not secrets.covered(0, 1, [])


def test_every_token_reaches_the_field():
    for text in ("my password: QwErTyUiOpAsDf", "the password is hunter", "a plain line of words", "né 漢字 x"):
        t = secrets._Tokens([text])
        codes, free = secrets._features(t)
        assert [text[t.starts[i] : t.ends[i]] for i in free] == text.replace(":", "").split() and len(codes) == len(free)


def test_letters_alone_are_found_beside_a_cue(docs):
    model = secrets.fit(docs)
    _, spans = secrets.scan_texts(model, ["and the password is QwErTyUiOpAsDfGhJkLz or so", "the token of the people in the city", "a secret is kept by them"])
    assert any(k == "crf" for k, _, _ in spans[0]) and not spans[1] and not spans[2]


def test_decoding_equals_viterbi_over_all_tokens():
    draw = np.random.default_rng(7)
    for scale in (0.5, 3.0, 12.0):
        for _ in range(20):
            n = int(draw.integers(1, 60))
            scores = draw.normal(size=(n, 3)) * scale + np.array([scale, 0.0, 0.0])
            first = np.unique(np.concatenate([[0], draw.integers(0, n, size=3)]))
            moves = draw.normal(size=(3, 3))
            moves[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
            assert (secrets.decode(scores, first, moves) == secrets.viterbi(scores, first, moves)).all()


def test_settled_tokens_are_most_of_a_text_and_none_is_lost():
    moves = np.zeros((3, 3))
    moves[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
    scores = np.array([[9.0, 0.0, 0.0], [0.0, 4.0, 1.0], [0.0, 0.0, 3.0], [9.0, 0.0, 0.0]])
    assert secrets.decode(scores, np.array([0]), moves).tolist() == [0, 1, 2, 0]
    assert secrets.settled(np.zeros((0, 3)), moves).tolist() == []


def test_recall_on_invented_secrets_that_no_pattern_finds(docs):
    model = secrets.fit(docs)
    made = [secrets.made_up(f"{r.text} {r.doc_id}") for r in docs.where("text IS NOT NULL").select("doc_id", "text").collect()]
    made = [m for m in made if m]
    base, every = secrets.scan_texts(model, [m[0] for m in made])
    hidden = [any(s < m[2] and e > m[1] for k, s, e in every[i]) for i, m in enumerate(made) if m[2] and not any(s < m[2] and e > m[1] for _, s, e in base[i])]
    alarms = [any(k == "crf" for k, _, _ in every[i]) for i, m in enumerate(made) if not m[2]]
    assert len(hidden) > 10 and sum(hidden) >= 0.9 * len(hidden)
    assert sum(alarms) <= 0.05 * len(alarms)
