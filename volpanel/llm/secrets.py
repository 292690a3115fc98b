"""Secret scans: fixed patterns, and a linear-chain conditional random field for the rest.

The field tags every token of a text as outside, begin or inside of a secret from its shape,
the words and signs around it and features of the file; Viterbi decodes it.  A token whose
own scores speak so clearly for "outside" that no neighbours can outweigh them is outside in
every best labelling (:func:`settled`); the others fall into chains between such tokens,
which are decoded side by side: an exact decoding of the whole.  The field learns from what the fixed patterns find in a bounded sample, without
seeing the patterns, and so finds their like where a pattern fails.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map, bounded_sample, cut

# The base patterns, kind by kind, with the least length of what is kept.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KEYWORDS = ("passw", "secret", "token", "api")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "basic", "credential", "pwd", "private")
PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb", "AIza", "eyJh", "sk_l", "-----")

OUTSIDE, BEGIN, INSIDE = range(3)
WINDOW = 8
INVENTED = 4
NEVER = -1e6
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Number of codes of each feature, in the order of :func:`_features`.
CODES = (10, 16, 5, 8, 5, len(CUES) + 1, 2, 16, 4, len(PREFIXES) + 1, 4, 3, 3, 4)


def _table(signs: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in signs]] = True
    return out


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
IN_TOKEN = _table(DIGITS + LOWER + UPPER + "+/_.-@~\\^")
CLASS = np.zeros(129, np.int8)  # of a character: 1 digit, 2 upper, 3 lower, 4 sign, 5 not ASCII, 0 none
for _code, _signs in enumerate((DIGITS, UPPER, LOWER, "+/_.-@~\\^"), 1):
    CLASS[[ord(c) for c in _signs]] = _code
CLASS[128] = 5
HEX_LETTER, HEX = _table("abcdef"), _table(DIGITS + "abcdef")


def _literal_hashes(words: tuple[str, ...]) -> np.ndarray:
    batch = K.Batch(list(words))
    return batch.hashes(batch.starts[:-1], batch.starts[1:] - 1)


class _Tokens:
    """Tokens of a batch with the prefix sums their features need."""

    def __init__(self, texts: list[str]) -> None:
        self.batch = batch = K.Batch(texts)
        codes = np.minimum(batch.codes, 128)
        self.kind = CLASS[codes]
        other = (codes == 128) & K.letters(batch.codes)
        inside = np.concatenate([IN_TOKEN, [False]])[codes] | other
        self.starts, self.ends = batch.runs(inside)
        self.owner = batch.owner(self.starts)
        self.codes = codes

    def sums(self, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])


def base_spans(texts: list[str], batch: K.Batch) -> list[list[tuple[str, int, int]]]:
    """Spans of the fixed patterns, text by text, by start and then kind."""
    out: list[list] = [[] for _ in texts]
    starts, ends = batch.runs(np.concatenate([HEX, [False]])[np.minimum(batch.codes, 128)])
    long = np.flatnonzero(ends - starts >= MIN_HEX)
    for i, start, end in zip(batch.owner(starts[long]).tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[i].append(("hex", start - int(batch.starts[i]), end - int(batch.starts[i])))
    for i, text in enumerate(texts):
        if "AKIA" in text:
            out[i] += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        folded = text.lower()
        if any(word in folded for word in KEYWORDS):
            out[i] += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if len(out[i]) > 1:
            out[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _features(t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes of all tokens, and their indices."""
    starts, ends, kind = t.starts, t.ends, t.kind
    size = ends - starts
    per = {k: t.sums(kind == c) for k, c in (("digit", 1), ("upper", 2), ("lower", 3), ("sign", 4), ("other", 5))}
    count = {k: s[ends] - s[starts] for k, s in per.items()}
    change = t.sums(np.concatenate([[False], kind[1:] != kind[:-1]]))
    # Words around.
    lowered = K.Batch.__new__(K.Batch)
    lowered.codes, lowered.starts, lowered.n, lowered._prefix = t.batch.codes + np.where(kind == 2, 32, 0).astype("<u4"), t.batch.starts, t.batch.n, None
    cue = np.zeros(len(starts), np.int64)
    for i, (word, value) in enumerate(zip(CUES, _literal_hashes(CUES), strict=True), 1):
        fits = np.flatnonzero((size >= len(word)) & (cue == 0) & (size <= 40))
        cue[fits[lowered.hashes(ends[fits] - len(word), ends[fits]) == value]] = i
    same = np.concatenate([[False], t.owner[1:] == t.owner[:-1]])
    before = np.where(same, np.concatenate([[0], cue[:-1]]), 0)
    before2 = np.where(same, np.concatenate([[0], before[:-1]]), 0)
    free = np.arange(len(starts))
    if not len(free):
        return np.zeros((0, len(CODES)), np.int64), free
    s, e, n = starts[free], ends[free], size[free]
    c = {k: v[free] for k, v in count.items()}
    hexes = t.sums(np.concatenate([HEX, [False]])[t.codes])
    all_hex = hexes[e] - hexes[s] == n
    only = np.select([c["digit"] == n, all_hex & (c["digit"] > 0), all_hex, (c["upper"] + c["lower"]) == n], [0, 1, 2, 3], 4)
    # Signs around.
    gap_start = np.where(same, np.concatenate([[0], ends[:-1]]), t.batch.starts[t.owner])[free]
    signs = [t.sums(_any_of(t.codes, x)) for x in ("=:", "\"'", "\n", "\t !#$%&*()[]{}<>|,;?")]
    gap = sum(((x[s] - x[gap_start] > 0).astype(np.int64) << b for b, x in enumerate(signs)), np.zeros(len(free), np.int64))
    quoted = (signs[1][np.minimum(e + 1, len(t.codes))] - signs[1][e] > 0).astype(np.int64)
    after = np.concatenate([cue[1:] * same[1:], [0]])[free] > 0
    prefix = np.zeros(len(free), np.int64)
    for i, value in enumerate(_literal_hashes(tuple(p[:4] for p in PREFIXES)), 1):
        fits = np.flatnonzero((n >= 4) & (prefix == 0))
        prefix[fits[t.batch.hashes(s[fits], s[fits] + 4) == value]] = i
    dots = t.sums(t.codes == ord("."))
    # The file: shares of digits and of other letters, and how often it speaks of secrets.
    low, high = t.batch.starts[:-1], t.batch.starts[1:]
    chars = np.maximum(high - low, 1)
    digits = np.digitize((per["digit"][high] - per["digit"][low]) / chars, (0.005, 0.05, 0.2))
    others = np.digitize((per["other"][high] - per["other"][low]) / chars, (0.01, 0.1))
    cues = np.minimum(np.bincount(t.owner, cue > 0, minlength=t.batch.n).astype(np.int64), 2)
    owner = t.owner[free]
    columns = [
        np.digitize(n, (4, 8, 12, 16, 20, 24, 32, 40, 64)),
        (c["digit"] > 0) + 2 * (c["upper"] > 0) + 4 * (c["lower"] > 0) + 8 * (c["sign"] > 0),
        only,
        np.digitize(change[e] - change[np.minimum(s + 1, e)], (1, 2, 3, 4, 6, 9, 14)),
        np.minimum(5 * c["digit"] // n, 4),
        before[free], (before2[free] > 0).astype(np.int64), gap, quoted + 2 * after, prefix,
        digits[owner], cues[owner], others[owner],
        np.minimum(dots[e] - dots[s], 3),
    ]
    return np.stack(columns, 1), free


def _any_of(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.concatenate([_table(signs), [False]])[codes]


OFFSETS = np.concatenate([[0], np.cumsum(CODES)[:-1]])


def _texts(t: _Tokens) -> np.ndarray:
    """The first token of each text that has any."""
    return np.flatnonzero(np.concatenate([[True], t.owner[1:] != t.owner[:-1]])) if len(t.owner) else np.zeros(0, np.int64)


def viterbi(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of many chains at once; ``scores`` (tokens x 3), ``first`` the chains' starts."""
    n = len(scores)
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best, back = np.empty_like(scores), np.zeros((n, 3), np.int8)
    best[first] = scores[first] + np.array([0.0, 0.0, NEVER])
    live, steps = len(first), int(size[0]) if len(size) else 0
    for step in range(1, steps):
        while live and size[live - 1] <= step:
            live = int(np.searchsorted(-size, -step, "left"))
        at = first[:live] + step
        options = best[at - 1][:, :, None] + moves
        back[at] = options.argmax(1)
        best[at] = options.max(1) + scores[at]
    labels = np.zeros(n, np.int8)
    ends = first + size - 1
    if n:
        labels[ends] = best[ends].argmax(1)
    for step in range(1, steps):
        live = int(np.searchsorted(-size, -step, "left"))
        at = ends[:live] - step + 1
        labels[at - 1] = back[at, labels[at]]
    return labels


def settled(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that are outside in every best labelling.

    To put a token outside changes its two moves; an "inside" after it must become "begin",
    with its own score and next move.  The margin of a settled token exceeds all that this
    can lose.
    """
    if not len(scores):
        return np.zeros(0, bool)
    later = max(0.0, float((scores[:, INSIDE] - scores[:, BEGIN]).max())) + max(0.0, float((moves[INSIDE] - moves[BEGIN]).max()))
    losses = [0.0]
    for x in (BEGIN, INSIDE):
        before = [moves[a, x] - moves[a, OUTSIDE] for a in range(3) if moves[a, x] > NEVER / 2] + [0.0]
        after = [moves[x, b] - moves[OUTSIDE, b] for b in (OUTSIDE, BEGIN)] + [moves[x, INSIDE] - moves[OUTSIDE, BEGIN] + later, 0.0]
        losses.append(max(before) + max(after))
    return scores[:, OUTSIDE] - scores[:, 1:].max(1) > max(losses)


def decode(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of texts that begin at ``first``: Viterbi over the chains between settled tokens."""
    n = len(scores)
    labels = np.zeros(n, np.int8)
    live = np.flatnonzero(~settled(scores, moves))
    if not len(live):
        return labels
    head = np.zeros(n + 1, bool)
    head[first] = head[n] = True
    begin = np.concatenate([[True], (np.diff(live) > 1) | head[live[1:]]])
    end = np.concatenate([begin[1:], [True]])
    own = scores[live].copy()
    own[begin & ~head[live]] += moves[OUTSIDE]
    own[end & ~head[live + 1]] += moves[:, OUTSIDE]
    labels[live] = viterbi(own, np.flatnonzero(begin), moves)
    return labels


def _gold(t: _Tokens, free: np.ndarray, texts: list[str], base: list[list]) -> np.ndarray:
    """Labels of the free tokens from the base spans (of an assignment: its value)."""
    labels = np.zeros(len(free), np.int8)
    s, e = t.starts[free], t.ends[free]
    for i, spans in enumerate(base):
        for kind, start, end in spans:
            if kind == "assign":
                start = ASSIGN.match(texts[i], start).start(2)
            low, high = start + t.batch.starts[i], end + t.batch.starts[i]
            inside = np.flatnonzero((s < high) & (e > low))
            labels[inside] = INSIDE
            if len(inside):
                labels[inside[0]] = BEGIN
    return labels


ALPHABETS = (DIGITS + LOWER + UPPER, DIGITS + LOWER + UPPER + "+/", DIGITS + UPPER, DIGITS + "abcdef", DIGITS + LOWER + "-_", LOWER + UPPER)
SEPARATORS = (' = "', ": ", "=", " is ", " ", " => '", '": "', " := ")


#: Of year, month, day, mixed letters and digits, hexadecimal digits.
HARMLESS = (
    "item?id={3}", "watch?v={3}&t={2}", "https://www.example.com/{3}", "IMG_{0}{1:02d}{2:02d}_{0}{2:02d}.jpg", "scan{0}_{1}.pdf", "commit {4}", "build {3}", "ref={3}", "order {0}{2:02d}{0}", "{0}-{1:02d}-{2:02d}T{1:02d}:{2:02d}:00Z",
    "{0}-{1:02d}-{2:02d}", "{1}.{2}.{0}.{2}", "555-{1:03d}-{0}", "user.{0}@mail.example.com", "v{1}.{2}.{0}-beta{1}", "https://www.example.com/en/{0}", "{0},{1}00.{2}", "{0}{1:02d}{2:02d}T{1:02d}{2:02d}00",
)
URLS = ("postgres://app:", "mysql://root:", "https://user:", "amqp://worker1:", "redis://:")
HOSTS = ("@db.example.com/main", "@10.0.0.7:5432", "@example.org", "@cache/0")


def _drawn(draw: np.random.Generator, signs: str, least: int, most: int) -> str:
    return "".join(signs[i] for i in draw.integers(len(signs), size=draw.integers(least, most)))


def made_up(text: str, turn: int = 0) -> tuple[str, int, int] | None:
    """A stretch of a text with an invented secret in it, and the secret's span; the same on every run.

    One time in two it is a date, address or number instead, and the span is empty.
    """
    middle = text.find(" ", len(text) // 2)
    if middle < 0:
        return None
    draw = np.random.default_rng([zlib.crc32(text.encode()), turn] if turn else zlib.crc32(text.encode()))
    if draw.integers(2) == 0:
        numbers = [int(draw.integers(a, b)) for a, b in ((1000, 9999), (1, 12), (1, 28))]
        value = HARMLESS[draw.integers(len(HARMLESS))].format(*numbers, _drawn(draw, ALPHABETS[0], 6, 13), _drawn(draw, ALPHABETS[3], 7, 9))
        return f"{text[max(0, middle - 120) : middle]} {value} {text[middle : middle + 120]}", 0, 0
    value = _drawn(draw, ALPHABETS[draw.integers(len(ALPHABETS))], 16, 48)
    lead, tail = f" {CUES[draw.integers(len(CUES))]}{SEPARATORS[draw.integers(len(SEPARATORS))]}", ""
    sort = draw.integers(8)
    if sort == 0:
        prefix = PREFIXES[draw.integers(len(PREFIXES) - 1)]
        value, lead = prefix + (value[:15].upper() if prefix in PREFIXES[:2] else _drawn(draw, ALPHABETS[0], 20, 40)), " "
    elif sort < 3:  # a short one, as people choose them
        value = _drawn(draw, ALPHABETS[4][:36], 7, 14) + str(draw.integers(100))
    elif sort == 3:
        value, lead, tail = _drawn(draw, ALPHABETS[0], 8, 20), f" {URLS[draw.integers(len(URLS))]}", HOSTS[draw.integers(len(HOSTS))]
    before, after = text[max(0, middle - 120) : middle] + lead, text[middle : middle + 120]
    return before + value + tail + ('"' if lead.endswith('"') else "") + after, len(before), len(before) + len(value)


SORTS = ("plain", "token with digits", "secret")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of WINDOW tokens with their labels and sort: all that hold a secret, half of those with long
    tokens with digits, one plain one in 64.

    Besides the texts themselves, each lends a stretch for INVENTED invented secrets.
    """
    for (raw,) in K.texts_of(batches):
        texts = [x or "" for x in raw]
        made = [m for x in texts for m in (made_up(x, turn) for turn in range(INVENTED)) if m]
        texts += [m[0] for m in made]
        t = _Tokens(texts)
        codes, free = _features(t)
        base = base_spans(texts, t.batch)
        for i, (_, start, end) in enumerate(made, len(raw)):
            base[i] = [("invented", start, end)]
        labels = _gold(t, free, texts, base)
        telling = (codes[:, 0] >= 2) & (codes[:, 1] & 1 == 1) if len(codes) else np.zeros(0, bool)
        first = _texts(t)
        small = codes.astype(np.uint8)
        rows: dict = {}
        for low, high in zip(first.tolist(), [*first.tolist(), len(free)][1:], strict=True):
            for a in range(low, high, WINDOW):
                b = min(a + WINDOW, high)
                data = small[a:b].tobytes() + labels[a:b].tobytes()
                sort = 2 if labels[a:b].any() else int(telling[a:b].any())
                if sort == 2 or zlib.crc32(data) % (64, 2)[sort] == 0:
                    rows[data] = sort
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int32())], ["data", "sort"])


def fit(docs: DataFrame, max_docs: int = 12000, max_examples: int = 8000, rounds: int = 150) -> dict:
    """Train the field on ``docs`` (doc_id, text): maximum conditional likelihood, by Adam.

    Bounded sample: the whole texts of at most ``max_docs`` documents of the smallest id
    hashes, of which at most ``max_examples`` distinct windows of WINDOW tokens of each sort
    are used.  Scans see whole texts; only training sees windows.
    """
    ids = bounded_sample(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), "doc_id", max_docs)
    windows = arrow_map(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text"), _examples, "data binary, sort int").distinct()
    windows = cut(windows)  # made once: the choice by sort would else go before them, and make them for each
    order = F.xxhash64("data"), F.col("data")
    kept = [windows.where(F.col("sort") == s).orderBy(*order).limit(max_examples) for s in range(len(SORTS))]
    data = sorted(bytes(r[0]) for r in kept[0].union(kept[1]).union(kept[2]).select("data").collect())
    return train(data, rounds)


def train(data: list[bytes], rounds: int = 150) -> dict:
    """Weights of the features and moves from windows of codes and labels.

    Tokens of equal codes have equal scores, so scores and gradients are made once for each
    distinct token; forward and backward sums are scaled probabilities, of all windows at once.
    """
    width = len(CODES)
    n = len(data)
    total = int(sum(CODES))
    weights, moves = np.zeros((total, 3)), np.zeros((3, 3))
    allowed = np.ones((3, 3))
    allowed[OUTSIDE, INSIDE] = 0.0
    barred = np.where(allowed > 0, 0.0, NEVER)
    size = np.array([len(row) // (width + 1) for row in data], np.int64)
    y = np.zeros((n, WINDOW), np.int64)
    live = np.arange(WINDOW) < size[:, None]
    y[live] = np.concatenate([np.frombuffer(row, np.int8, k, k * width) for row, k in zip(data, size.tolist(), strict=True)]) if n else 0
    if not y.any():
        weights[:, OUTSIDE] = 1.0
        return {"weights": weights.astype(np.float32), "moves": moves + barred}
    tokens = np.concatenate([np.frombuffer(row, np.uint8, k * width).reshape(k, width) for row, k in zip(data, size.tolist(), strict=True)])
    distinct, which = np.unique(np.ascontiguousarray(tokens).view(f"V{width}").ravel(), return_inverse=True)
    codes = distinct.view(np.uint8).reshape(-1, width).astype(np.int64) + OFFSETS
    none = len(codes)  # stands for the places behind a short window
    of = np.full((n, WINDOW), none)
    of[live] = which

    def by_feature(per_token: np.ndarray) -> np.ndarray:
        return sum(np.stack([np.bincount(codes[:, f], per_token[:, label], minlength=total) for label in range(3)], 1) for f in range(width))

    def by_token(per_place: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of.ravel(), per_place[..., label].ravel(), minlength=none + 1)[:none] for label in range(3)], 1)

    gold_w = by_feature(by_token(np.eye(3)[y] * live[..., None]))
    gold_m = np.zeros((3, 3))
    np.add.at(gold_m, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    for step in range(1, rounds + 1):
        score = sum(weights[codes[:, f]] for f in range(width))
        push = np.concatenate([np.exp(score - score.max(1, keepdims=True)), np.ones((1, 3))])[of]
        move = np.exp(moves) * allowed
        ahead, scale = np.empty((WINDOW, n, 3)), np.ones((WINDOW, n, 1))
        value = push[:, 0] * np.array([1.0, 1.0, 0.0])
        for k in range(WINDOW):
            if k:
                value = np.where(live[:, k, None], (ahead[k - 1] @ move) * push[:, k], ahead[k - 1])
            scale[k] = np.maximum(value.sum(1, keepdims=True), 1e-300)
            ahead[k] = value / scale[k]
        gone, model_m = np.empty((n, WINDOW, 3)), np.zeros((3, 3))
        behind = np.ones((n, 3))
        for k in range(WINDOW - 1, -1, -1):
            gone[:, k] = ahead[k] * behind
            if k:
                on = live[:, k, None]
                weight = np.where(on, push[:, k] * behind / scale[k], 0.0)
                model_m += move * (ahead[k - 1].T @ weight)
                behind = np.where(on, weight @ move.T, 1.0)
        gone *= live[..., None] / np.maximum(gone.sum(2, keepdims=True), 1e-300)
        model_w = by_feature(by_token(gone))
        for p, grad, (mean, square) in zip((weights, moves), ((gold_w - model_w) / n - 1e-4 * weights, (gold_m - model_m) / n - 1e-4 * moves), state, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            p += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return {"weights": weights.astype(np.float32), "moves": moves + barred}


def covered(start: int, end: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether spans, ordered by start, together hold all of a stretch."""
    for _, low, high in spans:
        if low <= start:
            start = max(start, high)
    return start >= end


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span of the field without the host of an address and without final stops, with the padding that belongs to it."""
    host = text.find("@", start + 1, end)
    if host > 0 and "://" in text[max(0, start - 40) : start]:
        return start, host
    while end > start + 1 and text[end - 1] in ".-":
        end -= 1
    padding = 2 - len(text[end : end + 2].lstrip("="))
    return start, end + (padding if padding > 0 and text[end : end + 1] == "=" and (end - start + padding) % 4 == 0 else 0)


def scan_texts(model: dict, raw: list[str | None]) -> tuple[list[list], list[list]]:
    """Base spans, and all spans (the base ones and the field's), text by text.

    A span of the field that goes beyond the base spans is kept whole and may overlap them.
    """
    texts = [x or "" for x in raw]
    t = _Tokens(texts)
    base = base_spans(texts, t.batch)
    codes, free = _features(t)
    every = [list(b) for b in base]
    if len(free):
        score = np.zeros((len(free), 3), np.float64)
        for f in range(len(CODES)):
            score += model["weights"][codes[:, f] + OFFSETS[f]]
        labels = decode(score, _texts(t), model["moves"])
        begins = np.flatnonzero(labels == BEGIN)
        for b in begins.tolist():
            e = b
            while e + 1 < len(labels) and labels[e + 1] == INSIDE:
                e += 1
            i = int(t.owner[free[b]])
            start, end = int(t.starts[free[b]] - t.batch.starts[i]), int(t.ends[free[e]] - t.batch.starts[i])
            start, end = trimmed(texts[i], start, end)
            if not covered(start, end, base[i]):
                every[i].append(("crf", start, end))
        for i in set(t.owner[free[begins]].tolist()):
            every[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base, every


def _structs(spans: list[list]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], SPAN_TYPE)


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text): doc_id, base spans, all spans.

    Spans are in code points, the end exclusive, by start and then kind.  Null and empty
    texts have none.  Rows are independent: repeated rows give repeated results, an empty
    table an empty one.  One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in K.texts_of(batches, "doc_id"):
            base, every = scan_texts(shared.value, raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _structs(base), _structs(every)], ["doc_id", "base", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict, mark: str = "[secret]") -> DataFrame:
    """``docs`` (any columns, with text) with secrets replaced, and n_chars, if there is one, to match; other rows as they are.

    Null and empty texts stay; rows are independent, so repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in K.parts_of(batches):
            _, every = scan_texts(shared.value, raw)
            texts = [redacted(x, spans, mark) if spans else x for x, spans in zip(raw, every, strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                sizes = [len(x) if spans else n for x, n, spans in zip(texts, part.column("n_chars").to_pylist(), every, strict=True)]
                new["n_chars"] = pa.array(sizes, part.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names)

    return arrow_map(docs, run, docs.schema)


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_of(docs: DataFrame) -> DataFrame:
    """Train on ``docs``, scan all: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    found = scan(docs, fit(docs))
    counts = [_number(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    extra = (F.size("spans") - F.size("base")).cast("long").alias("n_crf")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), extra)
