"""SentencePiece encoding by streaming Viterbi, and decoding.

The best path of pieces is found left to right. Scores and last pieces are kept
for a window of the longest piece only; back pointers are kept until the paths of
all positions in that window converge on one boundary, and then the ids before
it are committed. One solver encodes all text, whatever its length.

What makes a path the best follows from the kind of the model file. For unigram
pieces it is the sum of their log-probabilities. The scores of byte-pair pieces
are ranks of merges and no log-probabilities: there a step from one piece to the
next is possible if the merges, applied to the two alone, leave them apart, and
impossible otherwise. A row of pieces is what merging makes of their text exactly
if all its steps are possible - no merge crosses a boundary unless it does so
between the two pieces beside it - so each boundary has one path, and the ids are
those of the vocabulary's own encoder.

Where the vocabulary proves a boundary in advance - no piece joins the
characters on its two sides - all paths converge there, so what lies between two
such boundaries is solved once and its ids are remembered.

A space is written as U+2581 and one is put before the text; a U+2581 of the
text itself, and every character without a piece, becomes byte pieces, so that
decoding gives back the exact text if the vocabulary has a piece for the space.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textgrid import slices

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 300_000  # stretches kept by one worker
STEPS = 1 << 18  # steps between two pieces of which a worker knows whether they are possible
LONGEST = 64  # characters of a stretch that is remembered
STRETCH = 1 << 20  # characters of a text that are cut into stretches at once
_LETTER = r"[^\W\d_]"


@dataclass
class Vocabulary:
    """Pieces with ids and scores, the ids of the 256 byte pieces, whether scores are ranks of merges, and what follows from them."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    merging: bool = False
    longest: int = 0
    foreign: float = 0.0  # score of a character without a piece
    _memo: _Memo | None = field(default=None, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.foreign = min((s for _, s in self.pieces.values()), default=0.0) - 10

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read on the driver; executors get the vocabulary, not the path."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        described = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        if described.trainer_spec.model_type not in (described.trainer_spec.UNIGRAM, described.trainer_spec.BPE):
            raise ValueError(f"{path}: neither a unigram nor a byte-pair model")
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, model.get_score(i))
        return Vocabulary(pieces, byte_ids, described.trainer_spec.model_type == described.trainer_spec.BPE)

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    @property
    def memo(self) -> _Memo:
        if self._memo is None:
            self._memo = _Memo(self)
        return self._memo


_NEVER = float("inf")
_NONE, _UNASKED = -1, -2
_BITS = 24  # of the number of a piece or character


class Merges:
    """What the merges of byte-pair pieces make of a text: the pair with the best score first, the leftmost of equal ones."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.rank = {p: -s for p, (_, s) in pieces.items()}
        self._known: dict[str, tuple] = {}
        # pieces by their last character, the one before, and so on: what may come before, number of the piece (or _NONE, _UNASKED)
        self.names, self._numbers, self.root = [], {}, [{}, _NONE]
        for p in pieces:
            node = self.root
            for c in reversed(p):
                node = node[0].setdefault(c, [{}, _NONE])
            node[1] = _UNASKED
        self.steps: dict[int, bool] = {}

    def number(self, piece: str) -> int:
        """A number for a piece, or for a character that is none."""
        n = self._numbers.get(piece)
        if n is None:
            n = self._numbers[piece] = len(self.names)
            self.names.append(piece)
        return n

    def ask(self, node: list, piece: str) -> int:
        """The number of a piece that merging makes whole, or _NONE; kept in its node."""
        node[1] = self.number(piece) if len(piece) == 1 or self._of(piece)[0] else _NONE
        return node[1]

    def step(self, key: int) -> bool:
        """Whether the step of a key, two numbers of pieces, is possible."""
        if len(self.steps) >= STEPS:
            self.steps.clear()
        found = self.steps[key] = self.apart(self.names[key >> _BITS], self.names[key & (1 << _BITS) - 1])
        return found

    def apply(self, text: str) -> tuple[list[str], list[tuple[float, int]]]:
        """The pieces, and the rank and place of each merge in turn."""
        symbols, done = list(text), []
        while True:
            ranks = [self.rank.get(a + b) for a, b in zip(symbols, symbols[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return symbols, done
            at = ranks.index(best)
            done.append((best, at))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _of(self, piece: str) -> tuple:
        """Whether merging makes the piece whole, with rising ranks; and the symbols at its end, and at its start, with the rank that ends each."""
        known = self._known.get(piece)
        if known is None:
            symbols, done = self.apply(piece)
            ranks = [r for r, _ in done]
            last, first, now = [[piece[-1], _NEVER]], [[piece[0], _NEVER]], list(piece)
            for r, at in done:
                now[at : at + 2] = [now[at] + now[at + 1]]
                for spine, end in ((last, len(now) - 1), (first, 0)):
                    if at == end:
                        spine[-1][1] = r
                        spine.append([now[at], _NEVER])
            known = self._known[piece] = (len(symbols) == 1, all(a < b for a, b in zip(ranks, ranks[1:])), last, first)
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two whole pieces as they are, side by side.

        While their own merges go on by rising rank, a symbol at the end of one
        and one at the start of the other stand side by side; they are merged if
        that comes before the next merge of either. Where ranks do not rise, or
        are equal, the merges are carried out.
        """
        _, plain, ends, _ = self._of(left)
        _, simple, _, starts = self._of(right)
        if plain and simple:
            i = j = 0
            rank = self.rank
            while True:
                a, until_a = ends[i]
                b, until_b = starts[j]
                r = rank.get(a + b)
                if r is not None:
                    if r < until_a and r < until_b:
                        return False
                    if r == until_a or r == until_b:
                        break
                if until_a == until_b == _NEVER:
                    return True
                if until_a <= until_b:
                    i += 1
                else:
                    j += 1
        return self.apply(left + right)[0] == [left, right]


def viterbi(text: str, v: Vocabulary, merges: Merges | None = None) -> list[int]:
    """Ids of the best path: by the sum of scores (on equal ones the longer last piece wins, at every boundary), or by possible steps if there are merges."""
    out: list[int] = []
    pieces, longest, foreign = v.pieces, v.longest, v.foreign
    base, score, back = 0, [0.0], [0]  # of boundaries from base on
    lasts = [_NONE]  # numbers of the last pieces of the paths to boundaries from base on
    root, steps = (merges.root, merges.steps) if merges is not None else (None, None)

    def commit(to: int) -> None:
        at, path = to, []
        while at > base:
            before = back[at - base]
            piece = text[before:at]
            found = pieces.get(piece)
            path.append([found[0]] if found else [v.byte_ids[b] for b in piece.encode()])
            at = before
        for ids in reversed(path):
            out.extend(ids)

    for end in range(1, len(text) + 1):
        best, where = -_NEVER, end - 1
        if root is not None:
            node, start, number = root, end, _NONE
            while start > base:
                start -= 1
                node = node[0].get(text[start])
                if node is None:
                    break
                number = node[1]
                if number == _UNASKED:
                    number = merges.ask(node, text[start:end])
                if number >= 0:
                    last = lasts[start - base]
                    if last < 0:
                        where = start
                        break
                    key = last << _BITS | number
                    possible = steps.get(key)
                    if possible or possible is None and merges.step(key):
                        where = start
                        break
                    number = _NONE
            lasts.append(number if number >= 0 else merges.number(text[end - 1]))
        else:
            for start in range(max(base, end - longest), end):
                found = pieces.get(text[start:end])
                if found:
                    total = score[start - base] + found[1]
                    if total > best:
                        best, where = total, start
            total = score[end - 1 - base] + foreign
            if best == -_NEVER or (total > best and text[end - 1] not in pieces):
                best, where = total, end - 1
            score.append(best)
        back.append(where)
        if end - base >= 2 * longest and end % longest == 0:
            paths = set(range(end - longest + 1, end + 1))
            while len(paths) > 1:
                last = max(paths)
                paths.remove(last)
                paths.add(back[last - base])
                if last <= base:
                    break
            if len(paths) == 1 and (meet := paths.pop()) > base:
                commit(meet)
                del score[: meet - base], back[: meet - base], lasts[: meet - base]
                base = meet
    commit(len(text))
    return out


class _Memo(dict):
    """Ids, as bytes of 32-bit integers, of stretches between proven boundaries, which are kept with spaces as they are: a byte a character."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v
        is_letter = re.compile(_LETTER).match
        inner = {(a, b) for p in v.pieces for a, b in zip(p, p[1:])}
        joins_space = any(b == SPACE != a for a, b in inner)
        # pieces that go on from a letter to something else: where few letters do, those count as no letters
        before: dict[str, set[str]] = {}
        for a, b in inner:
            if is_letter(a) and b != SPACE and not is_letter(b):
                before.setdefault(b, set()).add(a)
        joined = {b for a, b in inner if is_letter(a) and is_letter(b)}
        odd = "".join(sorted(set().union(*(x for x in before.values() if len(x) <= 3)) - joined))
        guard = "".join(sorted(b for b, x in before.items() if x - set(odd)))
        letters = (f"(?:(?![{re.escape(odd)}]){_LETTER})" if odd else _LETTER) + "++" + (f"(?![{re.escape(guard)}])" if guard else "")
        alone = "" if any("\n" in p for p in v.pieces) else r"\n"
        # boundaries: a space after no space, what may not follow a letter, and a line's end that no piece holds
        parts = [alone, f" *+{letters}", f" *+[^ {alone}]+", " +"]
        self.split = re.compile(r"(?s).+" if joins_space else "|".join(x for x in parts if x)).findall
        self.one_piece = joins_space
        self.merges = Merges(v.pieces) if v.merging else None

    def __missing__(self, stretch: str) -> bytes:
        ids = array("i", viterbi(stretch.replace(" ", SPACE), self.v, self.merges)).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids


def _pieces_of(text: str):
    """Cuts of the text before a space that follows none, about STRETCH characters apart."""
    low = 0
    while low < len(text):
        high = low + STRETCH
        while 0 < high < len(text) and not (text[high] == " " and text[high - 1] != " "):
            high = text.find(" ", high + 1)
        if high <= 0:
            high = len(text)
        yield text[low:high]
        low = high


def encode(text: str, v: Vocabulary) -> np.ndarray:
    """Ids of the text, none for an empty one."""
    if not text:
        return np.empty(0, np.int32)
    memo, out = v.memo, []
    mark = np.array([v.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes()
    for nth, part in enumerate(text.split(SPACE)):
        if nth:
            out.append(mark)
        part = part if nth else " " + part
        for piece in [part] if memo.one_piece else _pieces_of(part):
            out.append(b"".join(map(memo.__getitem__, memo.split(piece))))
    return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    """Ids back to text."""

    def __init__(self, v: Vocabulary):
        size = max([*(i for i, _ in v.pieces.values()), *v.byte_ids]) + 1
        self.raw = [b""] * size
        for p, (i, _) in v.pieces.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(v.byte_ids):
            self.raw[i] = bytes([b])

    def decode(self, ids: np.ndarray) -> str:
        """Without the space that encoding put first."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode()


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids and round_trip (decoding gave the text back) for each row of docs.

    Null text gives null ids and a round trip of null; empty text gives no ids.
    Repeated rows and null ids come through; other columns are not read; no row
    moves between tasks.
    """
    v = vocabulary or Vocabulary.load()
    sent = docs.sparkSession.sparkContext.broadcast((v, Decoder(v)))

    def scan(batches):
        vocab, decoder = sent.value
        for batch in slices(batches):
            ids, ok = [], []
            for value in batch.column("text"):
                s = value.as_py()
                x = None if s is None else encode(s, vocab)
                ids.append(x)
                ok.append(None if x is None else decoder.decode(x) == s)
            sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            values = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in ids]))
            n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, lists, pa.array(ok, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    narrow = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text")
    return narrow.mapInArrow(scan, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Decoder(vocabulary or Vocabulary.load()))

    def scan(batches):
        for batch in batches:
            texts = [None if not x.is_valid else sent.value.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, text string")
