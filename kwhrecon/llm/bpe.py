"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding reads text in chunks of any size and holds a fixed amount of it:

* a pre-token is final once ``HOLD`` more characters are known (the longest
  contraction has three); a pre-token that outgrows the buffer stays open, and
  its bytes go on to the merge transducer as they come;
* the merge transducer emits a token once it ends more than ``lookahead``
  bytes before the end of what it holds. ``lookahead`` is computed from the
  merge list: a merge can only be lost to an earlier one that takes a part of
  its right operand, that one only to a still earlier one further right, and so
  on; the longest such chain bounds how far to the right a token depends.

Decoding turns ids into bytes and bytes into text by a UTF-8 state machine that
keeps at most three bytes. Ill-formed bytes become U+FFFD, as ids may be any.

Scale: documents are encoded where they lie, without a shuffle. A task keeps the
merge table (some 50,000 rules, a fixed size), caches of at most twice ``CACHE``
pre-tokens and one buffer; a document of any length adds nothing to that but its
digest states. Lost tasks are simply run again.

Edge cases: a null text is an empty one (no tokens, digests of the empty
string). The texts of special tokens become their ids, as the library's default
does. Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, read

CACHE, CHUNK, HOLD, SHORT = 1 << 18, 1 << 16, 4, 64

#: The splitting pattern of the public byte-level tokenizers.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How an open pre-token goes on, by the class of its characters.
GO_ON = (r"\p{L}", r"\p{L}+"), (r"\p{N}", r"\p{N}+"), (r"\s", r"\s+(?!\S)"), (r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(own)))
    return [letters[b] for b in range(256)]


def load(path: str) -> dict:
    """The tables of a byte-level BPE file: plain values, ready to travel with a task."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    vocab, of_letter = model["vocab"], {c: b for b, c in enumerate(letters)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rules = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    spelled = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
    return {"rules": rules, "bytes": [vocab[c] for c in letters], "special": special,
            "spelled": spelled, "lookahead": lookahead(rules, spelled)}


def lookahead(rules: dict[int, tuple[int, int]], spelled: dict[int, bytes]) -> int:
    """Bytes to the right of a token that its being final can depend on.

    Goes through the merges in order. ``reach[t]`` is the longest chain of
    earlier and earlier merges that can take token t away from its left side;
    ``inner[t]`` is that of the right-hand parts of t while t is being built.
    """
    reach: dict[int, int] = {}
    inner: dict[int, int] = {}
    longest = 0
    for key, (_, made) in sorted(rules.items(), key=lambda r: r[1][0]):
        a, b = key >> 32, key & 0xFFFFFFFF
        right = max(reach.get(b, 0), inner.get(b, 0))
        inner[made] = max(inner.get(made, 0), right)
        reach[a] = max(reach.get(a, 0), len(spelled[b]) + right)
        longest = max(longest, reach[a])
    return longest + max(map(len, spelled.values()))


class Recent(dict):
    """What ``make`` gave for the keys seen lately: at most ``CACHE`` new ones, and those before them."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Text chunks in, token ids out."""

    def __init__(self, tables: dict):
        self.rules, self.bytes, self.special = tables["rules"], tables["bytes"], tables["special"]
        self.spelled, self.lookahead = tables["spelled"], tables["lookahead"]
        self.window = max(4096, 8 * self.lookahead)
        #: token -> (rank, left, right) of the merge that makes it; bytes -> token, where its own bytes give it back
        self.parts = {made: (rank, key >> 32, key & 0xFFFFFFFF) for key, (rank, made) in self.rules.items()}
        self.whole = {self.spelled[t]: t for t in self.parts}
        self.whole |= {self.spelled[t]: t for t in self.bytes}
        self.follows = Recent(lambda key: self.fits(key >> 32, key & 0xFFFFFFFF))
        #: lengths of the tokens that begin with these three bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for raw in self.whole:
            if len(raw) > 2:
                lengths.setdefault(raw[:3], set()).add(len(raw))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        #: tokens of short byte strings; of short pre-tokens the ids as text, and the bytes that they spell
        self.tokens = Recent(self._cut)
        self.written = Recent(self._written)
        self.split = regex.compile(PRE_TOKENS)
        self.open = [(regex.compile(c), regex.compile(p)) for c, p in GO_ON]

    def fits(self, a: int, b: int) -> bool:
        """True if token b may follow token a: no merge across their border comes before those that build them.

        Undoes the merges of both from the last one back, and looks at each
        stage for a merge of the two parts that touch.
        """
        rules, parts = self.rules.get, self.parts
        taken_a = taken_b = 1 << 40
        while True:
            r = rules((a << 32) | b)
            if r is not None and r[0] < taken_a and r[0] <= taken_b:
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and pa_[0] > pb[0]:
                taken_a, a = pa_[0], pa_[2]
            else:
                taken_b, b = pb[0], pb[1]

    def _cut(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a short piece: its first token is the longest one that fits the tokens of the rest.

        There is one way to cut a piece in which all neighbours fit, so what is left
        of it without its first token is cut as a piece of its own would be.
        """
        whole, n = self.whole.get, len(piece)
        t = whole(piece)
        if t is not None:
            return (t,)
        for end in self.lengths.get(piece[:3], (2, 1)):
            if end < n and (t := whole(piece[:end])) is not None:
                rest = self.tokens[piece[end:]]
                if self.follows[(t << 32) | rest[0]]:
                    return (t, *rest)
        raise AssertionError("every byte is a token")

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a piece."""
        return list(self.tokens[piece]) if 0 < len(piece) <= SHORT else self.merge_long([self.bytes[b] for b in piece])

    def ids(self, piece: str) -> tuple[int, ...]:
        """Tokens of one whole pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) <= SHORT:
            return self.tokens[raw]
        return tuple(self.merge(raw) if len(raw) <= self.window else self.stable(raw, True)[0])

    def _written(self, piece: str) -> tuple[str, bytes]:
        ids = self.ids(piece)
        return ",".join(map(str, ids)), self.spell(ids)

    def spell(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of candidate merges over a linked list, for long pieces."""
        rule, n = self.rules.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(*r, i) for i in range(n - 1) if (r := rule((ids[i] << 32) | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            rank, made, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or rule((ids[i] << 32) | ids[j], (-1, -1))[0] != rank:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := rule((made << 32) | ids[after[i]]):
                    heapq.heappush(queue, (*r, i))
            if before[i] >= 0 and (r := rule((ids[before[i]] << 32) | made)):
                heapq.heappush(queue, (*r, before[i]))
        return [i for i in ids if i >= 0]

    def stable(self, held: bytes, ended: bool) -> tuple[list[int], bytes]:
        """The final tokens of the held bytes of one pre-token, and the bytes still open."""
        out: list[int] = []
        while len(held) > self.window or ended and held:
            part = held[:self.window]
            ids = self.merge(part)
            if ended and len(held) <= self.window:
                return out + ids, b""
            done = 0
            for i in ids:
                if done + len(self.spelled[i]) > len(part) - self.lookahead:
                    break
                done += len(self.spelled[i])
                out.append(i)
            held = held[done:]
        return out, held

    def _plain(self, chunks: Iterable[str]) -> Iterator[tuple[list[str], Iterable[int]]]:
        """Short pre-tokens, or ids of the others, in the order of text without special tokens."""
        held, open_, raw = "", None, b""
        for chunk, last in _with_last(chunks):
            held += chunk
            at, safe = 0, len(held) if last else len(held) - HOLD
            if open_ is not None:
                if safe <= 0 and not last:
                    continue
                more = open_.match(held)
                at = min(more.end() if more else 0, safe)
                raw += held[:at].encode("utf-8", "surrogatepass")
                ended = last or at < safe
                ids, raw = self.stable(raw, ended)
                yield [], ids
                if not ended:
                    held = held[at:]
                    continue
                open_ = None
            found, end = self.split.findall(held, at), len(held)  # the pre-tokens cover the text
            while end > safe and found:
                end -= len(found.pop())
            if max(map(len, found), default=0) <= SHORT:
                yield found, ()
            else:
                for short, group in itertools.groupby(found, lambda p: len(p) <= SHORT):
                    yield (list(group), ()) if short else ([], itertools.chain.from_iterable(map(self.ids, group)))
            held = held[end:]
            if len(held) > CHUNK:  # one pre-token fills the buffer: let its bytes through
                first = held[1] if held[0] == " " and not regex.match(r"\s", held[1]) else held[0]
                open_ = next(p for c, p in self.open if c.match(first))
                raw, held = held[:-HOLD].encode("utf-8", "surrogatepass"), held[-HOLD:]
                ids, raw = self.stable(raw, False)
                yield [], ids

    def plain(self, chunks: Iterable[str]) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """Lists of (ids, ids as text) of the pre-tokens of text without special tokens."""
        return map(self._entries, self._plain(chunks))

    def encode(self, chunks: Iterable[str]) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """Lists of (ids, ids as text) of any text; special tokens end what stands before them."""
        return map(self._entries, self.runs(chunks))

    def _entries(self, run: tuple[list[str], Iterable[int]]) -> list[tuple[tuple[int, ...], str]]:
        found, ids = run
        ids = tuple(ids)
        return [(self.ids(p), self.written[p][0]) for p in found] + ([(ids, ",".join(map(str, ids)))] if ids else [])

    def runs(self, chunks: Iterable[str]) -> Iterator[tuple[list[str], Iterable[int]]]:
        """Short pre-tokens, or ids of all else, in the order of any text."""
        if not self.special:
            yield from self._plain(chunks)
            return
        names = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        keep, stream, found = max(map(len, self.special)) - 1, iter(chunks), []
        held, over = "", False

        def until_special() -> Iterator[str]:
            nonlocal held, over
            while True:
                if m := names.search(held):
                    found.append(self.special[m.group()])
                    before, held = held[: m.start()], held[m.end():]
                    yield before
                    return
                if over:
                    rest, held = held, ""
                    yield rest
                    return
                ready = max(0, len(held) - keep)
                part, held = held[:ready], held[ready:]
                if part:
                    yield part
                try:
                    held += next(stream)
                except StopIteration:
                    over = True

        while True:
            found.clear()
            yield from self._plain(until_special())
            if not found:
                return
            yield [], (found[0],)


def _with_last(chunks: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Each chunk, and whether it is the last one."""
    before = None
    for chunk in chunks:
        if before is not None:
            yield before, False
        before = chunk
    yield before or "", True


class Decoder:
    """Token ids in, text out; a character is emitted once its bytes are complete."""

    def __init__(self, tables: dict):
        self.spelled = tables["spelled"]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """Text of the characters completed by these ids; ids that are in no vocabulary add nothing."""
        return self.feed_bytes(b"".join(map(self.spelled.get, ids, itertools.repeat(b""))))

    def feed_bytes(self, raw: bytes) -> str:
        """The same from the bytes that ids are spelled with."""
        return self.state.decode(raw)

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


def chunks_of(text: str, size: int = CHUNK) -> Iterator[str]:
    for lo in range(0, len(text), size):
        yield text[lo:lo + size]


def round_trip(text: str, encoder: Encoder, decoder: Decoder) -> tuple[int, str, str]:
    """Tokens, digest of the ids and digest of the decoded text, in bounded pieces."""
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    written = encoder.written.__getitem__
    for found, ids in encoder.runs(chunks_of(text)):
        if found:
            names, raws = zip(*map(written, found))
            names, raw = ",".join(names), b"".join(raws)
        else:
            ids = tuple(ids)
            if not ids:
                continue
            names, raw = ",".join(map(str, ids)), encoder.spell(ids)
        ids_sha.update(("," + names if n else names).encode())
        n += names.count(",") + 1
        text_sha.update(decoder.feed_bytes(raw).encode())
    text_sha.update(decoder.end().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _digests(ids: pa.Array, texts: pa.Array, state: dict) -> dict:
    if "encoder" not in state:
        state["encoder"] = Encoder(state["tables"])
        state["decoder"] = Decoder(state["tables"])
    rows = [round_trip(t.as_py() or "", state["encoder"], state["decoder"]) for t in texts]
    n, a, b = zip(*rows)
    return {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": list(a), "decoded_sha256": list(b)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    state = {"tables": load(path)}
    return by_document(documents, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                       ["doc_id", "text"], state)


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the tokens themselves, an array of int per document."""
    state = {"tables": load(path)}

    def work(ids, texts, state):
        encoder = state.setdefault("encoder", None) or Encoder(state["tables"])
        state["encoder"] = encoder
        return {"doc_id": ids, "ids": pa.array([[i for e in encoder.encode(chunks_of(t.as_py() or "")) for some, _ in e for i in some]
                                                for t in texts], pa.list_(pa.int32()))}

    return by_document(documents, work, "doc_id long, ids array<int>", ["doc_id", "text"], state)


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    state = {"tables": load(path)}

    def work(ids, lists, state):
        out = []
        for one in lists:
            decoder = Decoder(state["tables"])
            out.append(decoder.feed(i for i in one.as_py() or [] if i is not None) + decoder.end())
        return {"doc_id": ids, "text": pa.array(out, pa.string())}

    return by_document(tokens, work, "doc_id long, text string", ["doc_id", "ids"], state)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole text of ``documents``."""
    return encode_decode(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), default_path())
