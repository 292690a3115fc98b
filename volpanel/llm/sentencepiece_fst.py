"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file, each a table of weighted arcs
``state -> symbol -> (outputs, weight, next state)``:

* the normaliser writes the dummy prefix from its start state and U+2581 for a space;
* the pieces are a trie over characters; a node's closing arc writes an id, of weight 1, and
  leads back to the root;
* the byte fallback reads the bytes of a character that no piece spells and writes a byte
  piece for each, of weight 1.

A fourth table has the order of merges: a piece may follow another only if byte-pair merging
of the two together leaves the border between them.  A sequence in which all borders stand
is what merging gives for its text.

An input is composed with the machines as far as it reaches, and the tropical-semiring
shortest path (weights added along a path, the minimum over paths) is relaxed from position
to position; a state of the composition is a position and the last piece.  Where no piece
holds the two characters on either side of a border, every path passes through it, so the
input falls into independent parts there; their shortest paths are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.frames import arrow_map
from volpanel.llm.textkernel import parts_of

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
REMEMBERED = 200_000
LONG = 64
START, BODY = 0, 1  # states of the normaliser
FALLBACK = -1  # stands for the last piece at the start and after a character spelt in bytes
INFINITE = float("inf")

def read_model(path: str = MODEL_FILE) -> dict:
    """Pieces, scores and kinds of a BPE model file with identity normalisation; a few hundred KB."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in range(size)]
    return {"pieces": [model.id_to_piece(i) for i in range(size)], "scores": [model.get_score(i) for i in range(size)], "kinds": kinds, "unknown": model.unk_id()}


def compile_normaliser() -> list[dict]:
    """Arcs by state: from START the dummy prefix is written before the first symbol; a space becomes U+2581."""
    return [{" ": ((SPACE, SPACE), 0.0, BODY), None: ((SPACE,), 0.0, BODY)}, {" ": ((SPACE,), 0.0, BODY), None: ((), 0.0, BODY)}]


def compile_pieces(ids: dict[str, int]) -> tuple:
    """The trie of the pieces. A node: its arcs by character, and its closing arc to the root (id, weight), id -1 if none."""
    nodes: dict[str, list] = {"": [{}, -1, 0.0]}
    for piece, number in ids.items():
        for end in range(1, len(piece) + 1):
            if piece[:end] not in nodes:
                nodes[piece[:end]] = [{}, -1, 0.0]
                nodes[piece[: end - 1]][0][piece[end - 1]] = nodes[piece[:end]]
        nodes[piece][1:] = number, 1.0
    return nodes[""]


def compile_bytes(names: list[str], kinds: list[str], unknown: int) -> dict[int, tuple[int, float]]:
    """Arcs of the byte fallback: (id, weight) by byte; in a model without byte pieces all write the unknown piece."""
    return {int(names[i][3:5], 16): (i, 1.0) for i, k in enumerate(kinds) if k == "byte"}


class Transducer:
    """The compiled machines, their composition with an input, and the shortest paths it remembers."""

    def __init__(self, model: dict) -> None:
        self.names, self.scores, self.unknown, kinds = model["pieces"], model["scores"], model["unknown"], model["kinds"]
        self.ids = {p: i for i, p in enumerate(self.names) if kinds[i] == "piece"}
        self.is_byte = np.array([k == "byte" for k in kinds])
        plain = [p if k == "piece" else "" for p, k in zip(self.names, kinds, strict=True)]
        self.spelling = [bytes([int(p[3:5], 16)]) if k == "byte" else q.replace(SPACE, " ").encode() for p, q, k in zip(self.names, plain, kinds, strict=True)]
        self.inner = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        # Chunks begin at a space after another sign; a model with a piece across such a border has one chunk a text.
        self.chunked = not any(pair[1] == SPACE != pair[0] for pair in self.inner)
        self.traces: dict[str, list | None] = {}
        self.follows: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.normaliser = compile_normaliser()
        self.space = "".join(self.normaliser[BODY][" "][0])
        self.longest = max(map(len, self.ids), default=1)
        self.signs = frozenset(p for p in self.ids if len(p) == 1)
        self.pieces = compile_pieces({p: i for p, i in self.ids.items() if self.trace(p) is not None})
        self.bytes = compile_bytes(self.names, kinds, self.unknown)

    # -- the order of merges ---------------------------------------------------------------

    def trace(self, piece: str) -> list | None:
        """(score of the merge, last symbol, first symbol) after each merge that builds a piece; None if merging builds something else."""
        if piece not in self.traces:
            symbols, steps = list(piece), []
            while len(symbols) > 1:
                joint = [(self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.ids]
                if not joint:
                    break
                score, at = max(joint)
                symbols[-at : 2 - at] = ["".join(symbols[-at : 2 - at])]
                steps.append((score, symbols[-1], symbols[0]))
            self.traces[piece] = steps if len(symbols) == 1 else None
        return self.traces[piece]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the two pieces together never joins symbols across their border.

        The merges of both run in the order of their scores, the left ones first among
        equals; the border falls when the merge across it is next.
        """
        left, right = self.names[a], self.names[b]
        ahead, behind = self.trace(left), self.trace(right)
        x, y, i, j = left[-1], right[0], 0, 0
        while True:
            across = self.ids.get(x + y)
            score = self.scores[across] if across is not None else None
            one = ahead[i][0] if i < len(ahead) else None
            two = behind[j][0] if j < len(behind) else None
            if score is not None and (one is None or score > one) and (two is None or score >= two):
                return False
            if one is None and two is None:
                return True
            if two is None or one is not None and one >= two:
                x, i = ahead[i][1], i + 1
            else:
                y, j = behind[j][2], j + 1

    # -- composition and shortest path -----------------------------------------------------

    def normalised(self, text: str, state: int = START) -> str:
        """What the normaliser writes for an input from one of its states.

        Past its first symbol the machine only loops on BODY, whose one arc that writes is
        that of a space: there the rest is one replacement.
        """
        if state == BODY:
            return text.replace(" ", self.space)
        out: list[str] = []
        for symbol in text[:1]:
            arcs = self.normaliser[state]
            written, _, state = arcs.get(symbol) or arcs[None]
            out += written
            if symbol != " ":
                out.append(symbol)
        return "".join(out) + text[1:].replace(" ", self.space)

    def fallback(self, character: str) -> tuple[tuple[int, ...], float]:
        """Ids and weight of the path of a character's bytes; without byte pieces, of the unknown piece."""
        if not self.bytes:
            return (self.unknown,), 1.0
        arcs = [self.bytes[b] for b in character.encode()]
        return tuple(i for i, _ in arcs), sum(w for _, w in arcs)

    def fits(self, before: int, piece: int) -> bool:
        """The order of merges for two pieces, remembered."""
        key = before * len(self.names) + piece
        known = self.follows.get(key)
        if known is None:
            known = self.may_follow(before, piece)
            if len(self.follows) < REMEMBERED:
                self.follows[key] = known
        return known

    def only_path(self, text: str) -> list[int] | None:
        """The path of a text whose characters are all pieces, depth-first and longest arcs first.

        Where no bytes are spelt, borders decide alone: a position is reached with one piece
        at most, and one path reaches the end, which so is the shortest.  A position from
        which it cannot be reached is entered once.
        """
        n, size, known, longest, root = len(text), len(self.names), self.follows.get, self.longest, self.pieces[0]
        path, back, dead = [], [], set()
        at, before = 0, FALLBACK
        while at < n:
            arcs, after, found = root, at, []
            for symbol in text[at : at + longest]:
                node = arcs.get(symbol)
                if node is None:
                    break
                after += 1
                arcs, piece, _ = node
                if piece >= 0:
                    found.append((after, piece))
            while True:
                fits = False
                while found and not fits:
                    after, piece = found.pop()
                    if after not in dead:
                        fits = before < 0 or known(before * size + piece)
                        if fits is None:
                            fits = self.fits(before, piece)
                if fits:
                    back.append((at, before, found))
                    path.append(piece)
                    at, before = after, piece
                    break
                if not back:
                    return None
                dead.add(at)
                path.pop()
                at, before, found = back.pop()
        return path

    def shortest_path(self, text: str) -> bytes:
        """Ids of the path of least weight for one part of a normalised input.

        The composition has no cycles: a state is a position with the piece before it, and
        as borders decide alone, each position is reached with one piece at most.  So arcs
        are relaxed in the order of positions: the weight of a position is the least, over
        the arcs into it, of the weight before and the arc's.  A character spelt in bytes
        merges with nothing.
        """
        if self.signs.issuperset(text):
            path = self.only_path(text)
            if path is not None:
                return pack(f"<{len(path)}i", *path)
        return self.relaxed_path(text)

    def relaxed_path(self, text: str) -> bytes:
        """The same for any text, by relaxing every arc."""
        n, size, known, ids, longest, root = len(text), len(self.names), self.follows.get, self.ids, self.longest, self.pieces[0]
        weight, came, last = [INFINITE] * (n + 1), [0] * (n + 1), [FALLBACK] * (n + 1)
        weight[0] = 0.0
        for at in range(n):
            base = weight[at]
            if base == INFINITE:
                continue
            before, arcs, after = last[at], root, at
            row = before * size
            for symbol in text[at : at + longest]:
                node = arcs.get(symbol)
                if node is None:
                    break
                after += 1
                arcs, piece, own = node
                if piece >= 0 and (total := base + own) < weight[after]:
                    fits = before < 0 or known(row + piece)
                    if fits or fits is None and self.fits(before, piece):
                        weight[after], came[after], last[after] = total, at, piece
            if text[at] not in ids:
                total = base + self.fallback(text[at])[1]
                if total < weight[at + 1]:
                    weight[at + 1], came[at + 1], last[at + 1] = total, at, FALLBACK
        out, at = [], n
        while at > 0:
            out.append((last[at],) if last[at] >= 0 else self.fallback(text[came[at]])[0])
            at = came[at]
        flat = [i for ids in reversed(out) for i in ids]
        return pack(f"<{len(flat)}i", *flat)

    def parts_of(self, text: str) -> Iterator[str]:
        low, i, inner = 0, 0, self.inner
        for pair in zip(text, text[1:], strict=False):
            i += 1
            if pair not in inner:
                yield text[low:i]
                low = i
        yield text[low:]

    def chunk_ids(self, chunk: str, state: int) -> bytes:
        out = []
        for part in self.parts_of(self.normalised(chunk, state)):
            path = self.parts.get(part)
            if path is None:
                path = self.shortest_path(part)
                if len(part) <= LONG and len(self.parts) < REMEMBERED:
                    self.parts[part] = path
            out.append(path)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        chunks = CHUNK.findall(text) if self.chunked else [text]
        out, seen = [self.chunk_ids(chunks[0], START)], self.chunks
        for chunk in chunks[1:]:
            ids = seen.get(chunk)
            if ids is None:
                ids = self.chunk_ids(chunk, BODY)
                if len(chunk) <= LONG and len(seen) < REMEMBERED:
                    seen[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and byte runs in turn, without the dummy prefix."""
        text = b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Shared:
    """A broadcast model that each Python worker compiles once."""

    def __init__(self, docs: DataFrame, path: str) -> None:
        model = read_model(path)
        self.key = hashlib.sha256("\0".join(model["pieces"]).encode()).hexdigest()
        self.model = docs.sparkSession.sparkContext.broadcast(model)

    def machine(self) -> Transducer:
        known = _MACHINES.get(self.key)
        if known is None:
            _MACHINES.clear()
            known = _MACHINES[self.key] = Transducer(self.model.value)
        return known


_MACHINES: dict[str, Transducer] = {}


def encode(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Token ids of each row of ``docs`` (doc_id, text): doc_id, text, ids.

    Null and empty texts have no ids.  Rows are independent: repeated rows give repeated
    results, an empty table an empty one.  One pass, no shuffle; memory is bounded by a
    slice of rows and by the remembered paths.
    """
    shared = _Shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.machine()
        for part, raw in parts_of(batches):
            coded = [machine.encode(t or "") for t in raw]
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], ["doc_id", "text", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, text string, ids array<int>")


def decode(tokens: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Texts of token ids (doc_id, text, ids): doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded, round_trip.

    ``round_trip`` holds where the decoded text is the given one (null: empty, and U+2581
    stands for a space); null ids decode as none.
    """
    shared = _Shared(tokens, path)
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded string, round_trip boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.machine()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            doc_ids, ids, texts = batch.column("doc_id"), batch.column("ids"), batch.column("text")
            for i in range(batch.num_rows):
                own = np.asarray(ids[i].values, np.int32) if ids[i].is_valid else np.zeros(0, np.int32)
                text, given = machine.decode(own), (texts[i].as_py() or "").replace(SPACE, " ")
                rows.append((doc_ids[i].as_py(), len(own), int(machine.is_byte[own].sum()), hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), text, text == given))
                held += len(text)
                if held > 1 << 21 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0

    return arrow_map(tokens.select("doc_id", "text", "ids"), run, schema)


def tokens_of(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Encode every text, decode the ids, and report both: digests of ids and text, and the round trip."""
    return decode(encode(docs, path), path).select("doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), "round_trip")
