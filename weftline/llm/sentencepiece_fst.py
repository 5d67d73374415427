"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``Transducer`` compiles a model file into

* a normaliser: the dummy prefix and the escaping of spaces (models with a character map are
  refused);
* a piece automaton: each piece an arc from its first to its last character;
* byte fallback: a character without a piece is an arc that spells the pieces of its UTF-8 bytes, or
  the unknown piece in models without them, at the weight of the worst piece and ten more;
* weights. A unigram piece weighs its negative score, one of the user's next to nothing, and the tropical
  shortest path through the composition with a text is the encoding. A BPE model is not a sum of scores: there, the machine
  remembers the last piece, and a piece may follow another only at weight 0, if merging the two
  pieces' text by score gives just these two, and else at infinite weight. A text has one path of
  finite weight, which is what merging by score gives: pieces follow each other in an encoding if
  and only if each neighbouring pair does on its own.

In that machine a prefix of a word has one live state, its last piece, so that composition is
linear in the text. A BPE model's words (with the spaces before them) compose independently and frequent
ones are kept; unigram texts are composed whole. Runs of spaces, whose pieces share one score, merge from the left by rule.

Defined results: a null text is an empty one and has no ids; unpaired surrogates can't occur in
Spark strings; texts of any length are encoded whole; of paths of equal weight the one whose pieces start
earlier is taken (where the library's single precision rounds two such weights apart, it takes the other); repeated rows are encoded each; extra columns pass through, but ``ids``, ``n_ids`` and
``text`` are replaced; an empty table gives an empty result. Models with a character map, with pieces of the user's in BPE,
or with BPE pieces over spaces are refused. ``decode`` gives texts back exactly, but for U+2581, which reads as a space, and for
characters that a model without byte fallback doesn't know.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import CACHES, task_started
from .tokens import _Both

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose ids a Python worker keeps.
MEMO_WORDS = 300_000
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_LOADED: dict[str, Transducer] = {}


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.kind = model.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model's normaliser or kind is not covered")
        self.dummy = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        own = {p for p, t in zip(self.pieces, self.types, strict=True) if t == USER}
        if own and (self.kind == BPE or any(" " in p or SPACE in p for p in own)):
            raise ValueError("pieces of the user's that words or merges would cut are not covered")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        self.longest = max(map(len, self.ids))
        # words compose apart unless a piece goes on after a space or over the end of a line
        self.apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids)
        self._compile_weights()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}
        spell = {NORMAL: lambda i: self.pieces[i].replace(SPACE, " ").encode(), UNKNOWN: lambda i: " ⁇ ".encode(), CONTROL: lambda i: b"", BYTE: lambda i: bytes([int(self.pieces[i][3:5], 16)])}
        self.spelled = [spell.get(t, spell[NORMAL])(i) for i, t in enumerate(self.types)]
        self.follows: dict[int, bool] = {}
        self.runs: dict[int, tuple[int, ...]] = {}
        if self.kind == BPE:
            self._compile_merges()

    # -- compiling

    def _compile_weights(self) -> None:
        """The arcs of the piece automaton by their text, with tropical weights."""
        normal = [self.score[i] for i, t in enumerate(self.types) if t == NORMAL]
        least = min(normal)
        self.weight: dict[str, tuple[float, int]] = {}
        for p, i in self.ids.items():
            gain = -0.1 if self.types[i] == USER else self.score[i]
            self.weight[p] = -gain, i
        # a character without a piece: the unknown piece, or the pieces of its bytes, at one weight
        self.fallback = 10.0 - least

    def _merged(self, text: str) -> list[int]:
        """Merging by score, from the left among equals: what BPE means, used to compile only."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[self.ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids), default=None)  # noqa: B905
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] if p in self.ids else -1 for p in parts]

    def _compile_merges(self) -> None:
        """For each piece the two it is merged from, and for each such two their piece."""
        n = len(self.pieces)
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [0.0] * n
        self.merge: dict[int, int] = {}
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) == 1 or set(p) == {SPACE}:
                continue
            self.rank[i] = 1.0 - self.score[i]
            # its halves are pieces that may follow each other, the last merge of its text
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None and self._reached(a) and self._reached(b) and self.rank[a] < self.rank[i] and self.rank[b] < self.rank[i] and self._may_follow(a, b, self.rank[i]):
                    self.left[i], self.right[i] = a, b
                    self.merge[a << 20 | b] = i
                    break
        # arcs from each beginning of a piece: the piece's id, or -1 where only longer ones go on
        self.arcs = {p[:k]: -1 for p, i in self.ids.items() if self._reached(i) for k in range(1, len(p) + 1)}
        self.arcs |= {p: i for p, i in self.ids.items() if self._reached(i)}
        # the same from the right: what pieces end in
        self.ends = {p[k:]: -1 for p, i in self.ids.items() if self._reached(i) for k in range(len(p))}
        self.ends |= {p: i for p, i in self.ids.items() if self._reached(i)}
        self.sizes = [len(p) for p in self.pieces]
        self.characters = {p for p in self.ids if len(p) == 1}
        inside = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        self.joined = inside.__contains__

    def _reached(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or self.left[i] >= 0

    def _may_follow(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether nothing merges across the border of a and b before ``limit``.

        Undoes the merges next to the border, the latest first, and looks whether the pieces then
        at the border would have merged earlier than what was undone.
        """
        merge, rank, left, right = self.merge, self.rank, self.left, self.right
        while True:
            both = merge.get(a << 20 | b)
            if both is not None and rank[both] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = right[a]
            elif rank[b]:
                limit = rank[b] + 0.5  # of equal merges the left one comes first
                b = left[b]
            else:
                return True

    # -- composing

    def _bpe(self, text: str) -> list[int]:
        """The path through ``text``, all of whose characters have pieces."""
        follows, arcs, n = self.follows, self.arcs, len(text)
        whole = arcs.get(text, -1)
        if whole >= 0:
            return [whole]
        last = [-1] * (n + 1)
        before = -1
        for start in range(n):
            if start:
                before = last[start] << 20
            for end in range(start + 1, n + 1):
                t = arcs.get(text[start:end])
                if t is None:
                    break
                if t < 0 or last[end] >= 0:
                    continue
                if start:
                    ok = follows.get(before | t)
                    if ok is None:
                        if len(follows) > 600_000:
                            follows.clear()
                        ok = follows[before | t] = self._may_follow(last[start], t)
                    if not ok:
                        continue
                last[end] = t
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(self.pieces[last[end]])
        return out[::-1]

    def _unigram(self, text: str) -> list[int]:
        """The tropical shortest path through the composition of ``text`` with pieces and fallback; of equal ones, the one of earlier arcs."""
        n, weight, none = len(text), self.weight, -1
        cost, back = [float("inf")] * (n + 1), [(none, 0)] * (n + 1)
        cost[0] = 0.0
        for start in range(n):
            here, single = cost[start], False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                arc = weight.get(text[start:end])
                if arc is not None:
                    single = single or end == start + 1
                    if here + arc[0] < cost[end]:
                        cost[end], back[end] = here + arc[0], (arc[1], start)
            if not single and here + self.fallback < cost[start + 1]:
                cost[start + 1], back[start + 1] = here + self.fallback, (none, start)
        out: list[int] = []
        end = n
        while end:
            t, start = back[end]
            if t != none:
                out.append(t)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            elif not out or out[-1] != self.unknown:  # unknown characters in a row are one piece
                out.append(self.unknown)
            end = start
        return out[::-1]

    def _spaces(self, n: int) -> tuple[int, ...]:
        if n not in self.runs:
            self.runs[n] = tuple(self._merged(SPACE * n)) if n <= 64 else self._long_run(n)
        return self.runs[n]

    def _long_run(self, n: int) -> tuple[int, ...]:
        """Rounds of merging neighbours from the left, as equal scores have it."""
        parts = [1] * n
        lengths = sorted(len(p) for p in self.ids if set(p) == {SPACE})
        held = set(lengths)
        while True:
            out, k, changed = [], 0, False
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] + parts[k + 1] in held:
                    out.append(parts[k] + parts[k + 1])
                    k, changed = k + 2, True
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
            if not changed:
                return tuple(self.ids[SPACE * x] for x in parts)

    def _part(self, text: str) -> tuple[int, ...]:
        found = self.memo.get(text)
        if found is None:
            found = tuple(self._bpe(text))
            if len(self.memo) < MEMO_WORDS:
                self.memo[text] = found
        return found

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of one word with the spaces before it."""
        path = self._bpe
        lead = len(unit) - len(unit.lstrip(SPACE))
        word = unit[max(0, lead - 1) :] if lead else unit
        out: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in self.ids:
                if k > start:
                    out += path(word[start:k])
                start = k + 1
                out += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
            elif k > start and not self.joined(word[k - 1 : k + 1]):  # no piece has these two
                out += self._part(word[start:k])
                start = k
        if start < len(word):
            out += self._part(word[start:]) if start else path(word[start:])
        if lead > 1:  # spaces that no letter took
            alone = out[0] == self.ids.get(SPACE)
            out = list(self._spaces(lead if alone else lead - 1)) + out[1 if alone else 0 :]
        return tuple(out)

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words after one space each, as little-endian 32-bit bytes.

        In order, words share beginnings, and with them the states of the machine.
        """
        found: dict[str, bytes] = {}
        ends, follows, sizes = self.ends, self.follows, self.sizes
        before, last = "", [-1]  # last[k]: the piece in which the first k characters end
        for word in sorted(words):
            if not self.characters.issuperset(word):
                found[word] = self._word(word)
                continue
            text = SPACE + word
            n, same = len(text), 0
            for a, b in zip(before, text):  # noqa: B905
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, n + 1):
                start = end - 1
                while start >= 0:
                    t = ends.get(text[start:end])
                    if t is None:
                        break
                    if t >= 0:
                        if not start:
                            break
                        key = last[start] << 20 | t
                        ok = follows.get(key)
                        if ok is None:
                            if len(follows) > 600_000:
                                follows.clear()
                            ok = follows[key] = self._may_follow(last[start], t)
                        if ok:
                            break
                    start -= 1
                last.append(t)
            before = text
            ids, end = [], n
            while end:
                t = last[end]
                ids.append(t)
                end -= sizes[t]
            ids.reverse()
            found[word] = array("i", ids).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        """The same for one word of any characters."""
        ids: list[int] = []
        for unit in UNIT.findall(SPACE + word):
            ids += self._unit(unit) if unit[0] == SPACE else self._part_of_line(unit)
        return np.array(ids, dtype="<i4").tobytes()

    def _part_of_line(self, unit: str) -> tuple[int, ...]:
        found = self.memo.get(unit)
        if found is None:
            found = self._unit(unit)
            if len(self.memo) < MEMO_WORDS:
                self.memo[unit] = found
        return found

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        out = []
        words = self.words
        if self.kind == UNIGRAM or not self.apart:  # unknown pieces may join, and pieces go, over the borders of words
            return [np.array(self._whole(t), dtype="<i4").tobytes() for t in texts]
        plain = [bool(t) and self.dummy and t[0] != " " and "  " not in t and SPACE not in t for t in texts]
        split = [t.split(" ") if ok else None for t, ok in zip(texts, plain, strict=True)]
        new = self._new_words([w for w in set().union(*(x for x in split if x)) if w not in words])
        room = MEMO_WORDS - len(words)
        if len(new) <= room:
            words.update(new)
            known = words
        else:
            if room > 0:
                words.update(dict(list(new.items())[:room]))
            known = _Both(new, words)
        for text, parts in zip(texts, split, strict=True):
            if parts:
                out.append(b"".join([known[w] for w in parts]))
            elif not text:
                out.append(b"")
            else:
                text = text.replace(" ", SPACE)
                units = UNIT.findall(SPACE + text if self.dummy else text)
                out.append(np.array([i for u in units for i in self._part_of_line(u)], dtype="<i4").tobytes())
        return out

    def _whole(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.kind == BPE:
            raise ValueError("a BPE model whose pieces go over spaces or lines is not covered")
        text = text.replace(" ", SPACE)
        return self._unigram(SPACE + text if self.dummy else text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 read as U+FFFD."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


def _empty() -> None:
    for machine in _LOADED.values():
        machine.memo.clear()
        machine.words.clear()
        machine.follows.clear()


CACHES.append(_empty)


def transducer(path: str) -> Transducer:
    """The transducer of this Python worker for a model file."""
    task_started()
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``ids`` and their number ``n_ids``."""
    keep = [c for c in docs.columns if c not in {text, "ids", "n_ids"}]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType())])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in found:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = machine.encode_bytes(part.column(part.num_columns - 1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(sizes)], [f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(read, schema)


def decoded(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the ``text`` of ``ids``."""
    keep = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in found:
            at = batch.schema.get_field_index(ids)
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column(at)
                ends, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
                texts = [machine.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return rows.select(*keep).mapInArrow(read, schema)
