"""SentencePiece encoding and decoding (6) by a shared-prefix Viterbi.

A text is cut before each run of spaces into words that carry their marks; no piece
crosses such a cut. A block's distinct words are sorted, which lays them out as a trie in
depth-first order: going from a word to the next, the forward states of the common prefix
stay and only the rest is computed. Backtracking from a word's end gives its pieces.

The vocabulary is of the merging kind: what the library yields is not the path with the
largest sum of scores but the one that merging by score, leftmost first, ends with. So a
step of the Viterbi from piece a to piece b is admissible if merging the letters of a + b
ends with exactly (a, b); a sequence is the merges' result if and only if all neighbours
are admissible, so each prefix has one forward state, the last piece of its own result.
Admissibility is remembered by pair. Characters without a piece become their UTF-8 bytes.

The vocabulary is read on the driver from a file whose path is a parameter and sent to
executors (32,000 short strings, whatever the input); nothing is trained.

Defined results: null and empty texts have no pieces and decode to an empty text;
decode(encode(text)) is the text exactly, which for the mark character itself (U+2581)
takes its bytes, where the library would turn it into a space; repeated rows get equal
pieces; a text of any length is one row, and one without spaces is one word that is not remembered; of equal merges the leftmost comes first. Columns of the input may have any names: new ones are named ids and
decoded, with _ after names that are taken (see common.renamed). An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import released, renamed, with_columns_of_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that the text itself has, which no piece may take for a space.
LITERAL = "\0" + MARK
#: Letters of the Latin script, before whose punctuation words may be cut.
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Words that a worker remembers at most beside a block's; then it starts afresh. Longer words than LONG characters go with their block.
REMEMBERED, LONG = 250_000, 64
#: Between tasks a worker keeps the words of at most so many characters, which are the frequent ones.
SHORT = 5


def vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte or other."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.score = {p: s for p, s, kind in pieces if kind == "piece"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.value = {i: b for b, i in self.bytes.items()}
        self.surface = [p.replace(MARK, " ") if kind == "piece" else chr(self.value[i]) if self.value.get(i, 128) < 128 else "" for i, (p, _, kind) in enumerate(pieces)]
        self.partial = np.array([self.value.get(i, 0) >= 128 for i in range(len(pieces))])
        #: Lengths of the pieces that a merge ends with by itself, longest first, by their last two characters.
        self.lengths: dict[str, tuple[int, ...]] = {}
        found: dict[str, set[int]] = {}
        self.whole = {p for p in self.ids if self.merged(p) == [p]}
        for p in self.whole:
            if len(p) > 1:
                found.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}
        # The last merge of each piece. Where scores do not fall from parts to wholes, pairs are merged in full.
        self.last_merge, self.plain = {}, {p for p in self.ids if len(p) == 1}
        for p in sorted(self.whole, key=len):
            if len(p) > 1:
                a, b = self.last_merge[p] = self.merged(p, 2)
                if {a, b} <= self.plain and self.score[p] < min(self.score[x] for x in (a, b)) and MARK * 2 not in p:
                    self.plain.add(p)
                elif {a, b} <= self.plain and len(a) == len(b) == 1 and MARK * 2 not in p:
                    self.plain.add(p)
        # Words are cut before marks, and between a letter and punctuation that no piece has after a letter.
        beside = {x for p in self.ids for x, y in zip(p[1:], p) if re.fullmatch(LETTER, y)}
        tail = re.escape("".join(x for x in ".,;:!?|" if x not in beside) + "\0")
        self.word = re.compile(f"{MARK}*[^{MARK}{tail}]*{LETTER}(?![^{MARK}{tail}])|{MARK}*[^{MARK}]+|{MARK}+")
        self.packed = {p: int(i).to_bytes(4, "little") for p, i in self.ids.items()}
        #: Of each piece the pieces before it that were looked at, and whether it may follow them.
        self.pairs: dict[str, dict[str, bool]] = {p: {} for p in self.whole if len(p) > 1}
        #: Ids of words that were met before.
        self.cores: dict[str, bytes] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """What merging ends with, or the first that has so few parts: the best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, a: str, b: str) -> bool:
        """Whether b may follow a; "" stands before the first piece."""
        ok = not a or (self._apart(a, b) if a in self.plain and b in self.plain else self.merged(a + b) == [a, b])
        self.pairs[b][a] = ok
        return ok

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge across the border comes before one that takes its parts away.

        x and y are the pieces that touch at the border. Going back in time, the later
        of the merges that made them is undone; while they touched, x + y must not have
        been a better merge than the one that ended that time, or an equal one to the right.
        """
        score, made = self.score, self.last_merge
        x, y, limit, right = a, b, None, False
        while True:
            s = score.get(x + y)
            if s is not None and (limit is None or s > limit or (s == limit and right)):
                return False
            if len(x) == 1 and len(y) == 1:
                return True
            sx, sy = (score[x] if len(x) > 1 else None), (score[y] if len(y) > 1 else None)
            if sy is None or (sx is not None and sx < sy):
                limit, right, x = sx, False, made[x][1]
            else:
                limit, right, y = sy, True, made[y][0]

    def viterbi(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of the sorted distinct words, as 32-bit numbers."""
        lengths, pairs, admissible, packed = self.lengths, self.pairs, self.admissible, self.packed
        last: list[str] = [""]  # by length of the prefix: the last piece of its result
        before, out = "", {LITERAL: self._as_bytes(MARK)}
        for w in words:
            if w == LITERAL:
                continue
            k, n = 0, min(len(before), len(w))
            while k < n and before[k] == w[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                for size in lengths.get(w[i - 2 : i], ()) if i > 1 else ():
                    if size <= i and (known := pairs.get(p := w[i - size : i])) is not None:
                        a = last[i - size]
                        ok = known.get(a)
                        if ok or (ok is None and admissible(a, p)):
                            last.append(p)
                            break
                else:
                    last.append(w[i - 1])
            ids, i = [], len(w)
            while i:
                p = last[i]
                i -= len(p)
                ids.append(packed.get(p) or self._as_bytes(p))
            ids.reverse()
            out[w] = b"".join(ids)
            before = w
        return out

    def _as_bytes(self, text: str) -> bytes:
        return b"".join(int(self.bytes[b]).to_bytes(4, "little") for b in text.encode())

    def cut(self, text: str) -> list[str]:
        """The words of a text, with marks for its spaces and one before all."""
        if not text:
            return []
        if MARK not in text:
            return self.word.findall(MARK + text.replace(" ", MARK))
        out = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(LITERAL)
            part = part.replace(" ", MARK) if k else MARK + part.replace(" ", MARK)
            out += self.word.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        cut, cores = [self.cut(t) for t in texts], self.cores
        if len(cores) > REMEMBERED:
            cores.clear()
        new = self.viterbi(sorted(set().union(*cut).difference(cores)))
        cores.update(new)
        out = [b"".join([cores[w] for w in ws]) for ws in cut]
        for w in new:
            if len(w) > LONG:
                del cores[w]
        return out

    def forget(self) -> None:
        """Keeps the short words only."""
        self.cores = {w: ids for w, ids in self.cores.items() if len(w) <= SHORT}

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        if not self.partial[ids].any():
            return "".join([surface[i] for i in ids.tolist()])[1:]
        value, out, held = self.value, [], bytearray()
        for i in ids.tolist():
            if i in value:
                held.append(value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(surface[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)[1:]


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec, made once for a vocabulary."""
    key = hash(tuple(shared.value))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _id_lists(ids: list[bytes]):
    import pyarrow as pa

    ends = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


#: Bytes of text whose words make one trie.
BLOCK_BYTES = 4_000_000


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs with a column of piece ids."""
    (column,) = renamed(docs, "ids")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        codec = _codec(shared)

        def work(texts):
            return [_id_lists(codec.encode(texts))]

        work.done = codec.forget
        return work

    return with_columns_of_text(docs, text_col, f"`{column}` array<int>", make, BLOCK_BYTES)


def decode(rows: DataFrame, path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """rows with a column of the text that the ids stand for; null ids count as none."""
    (column,) = renamed(rows, "decoded")
    from pyspark.sql.types import StringType, StructField, StructType

    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    at, names = rows.columns.index(ids_col), [*rows.columns, column]

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared)
        for batch in batches:
            step = 500
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = pa.array([codec.decode(x.values.to_numpy() if x.is_valid and len(x) else np.zeros(0, np.int32)) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)
        released()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, StringType())]))


def tokenised(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs with ids instead of the text, their number, the decoded text's sha256, and whether it is the text.

    Both ways are taken in one worker, so that texts travel once and nothing of them back.
    """
    ids, n, digest, ok = renamed(docs, "ids", "n_tokens", "decoded_sha256", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        codec = _codec(shared)

        def work(texts):
            found = codec.encode(texts)
            back = [codec.decode(np.frombuffer(x, "<i4")) for x in found]
            return [_id_lists(found), [len(x) // 4 for x in found], [hashlib.sha256(t.encode()).hexdigest() for t in back], [a == b for a, b in zip(texts, back)]]

        work.done = codec.forget
        return work

    return with_columns_of_text(docs, text_col, f"`{ids}` array<int>, `{n}` bigint, `{digest}` string, `{ok}` boolean", make, BLOCK_BYTES, keep_text=False)
