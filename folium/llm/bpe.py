"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

From the merge list alone follows how far to the right of a place text can still change the
tokens that end there: a merge (v, w) takes v away from a merge (u, v) only if it ranks
before it, and whether w is there depends in the same way on merges of still earlier rank.
The longest such chain, in symbols, is the *sufficient lookahead*. The transducer keeps that
many symbols and emits each token that ends before them: memory is constant however long a
word is. Since no merge crosses the end of a final token, it goes on from there afresh.
Decoding goes token by token through a byte-to-text state machine that holds back the
bytes of an unfinished character.

Defined cases: a null text is empty (no ids); repeated rows are rows of their own; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
_CACHE = 200_000  # words of which a worker remembers the ids
_SHORT = 48  # symbols up to which a word is encoded at once


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a token's end that suffice to know that it is final."""
    made: dict[str, list[tuple[int, str]]] = {}  # token: merges that make it, with their right parts
    ranks: dict[str, list[int]] = {}  # left part: ranks of its merges, rising
    reach: dict[str, list[int]] = {}  # with them: the farthest reach up to that rank

    def before(symbol: str, rank: int) -> int:
        at = bisect_left(ranks.get(symbol, ()), rank)
        return reach[symbol][at - 1] if at else 0

    def spine(symbol: str, rank: int) -> int:
        """Farthest influence past the end of a symbol that must stand there at a rank."""
        far = before(symbol, rank)
        for own, right in made.get(symbol, ()):
            far = max(far, spine(right, own))
        return far

    most = 0
    for rank, (left, right) in enumerate(merges):
        far = length[right] + spine(right, rank)
        made.setdefault(left + right, []).append((rank, right))
        ranks.setdefault(left, []).append(rank)
        so_far = reach.setdefault(left, [])
        so_far.append(max(far, so_far[-1] if so_far else 0))
        most = max(most, far)
    return most


class WordBpe:
    """A tokenizer file of the kind ``word_bpe``: pieces of text, byte symbols, merges with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: s for s, i in self.ids.items()}, **{i: s for s, i in self.special.items()}}
        self.names = [names[i] for i in range(len(names))]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        self.lookahead = lookahead(merges, {s: len(s.removesuffix(END)) for s in self.ids})
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.plain = [self._plain(s) for s in self.names]
        self.known: dict[str, tuple[bytes, str]] = {}

    def _plain(self, name: str) -> bytes:
        if name in self.special:
            return name.encode()
        ends = name.endswith(END) and name != END
        body = bytes(self.bytes[c] for c in (name[: -len(END)] if ends else name))
        return body + b" " if ends else body

    # -- encoding

    def merged(self, parts: list[str]) -> list[str]:
        """All merges of a list of symbols, lowest rank first, leftmost first."""
        ranks = self.ranks
        while len(parts) > 1:
            best, pair = None, None
            for p in zip(parts, parts[1:]):  # noqa: B905
                r = ranks.get(p)
                if r is not None and (best is None or r < best):
                    best, pair = r, p
            if pair is None:
                break
            left, right = pair
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == left and parts[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a word's symbols (the last one with the word end), emitted once stable."""
        keep, room = self.lookahead, max(self.lookahead, 64)
        buffer: list[str] = []
        for s in symbols:
            buffer.append(s)
            if len(buffer) >= keep + room:
                at = 0
                for token in self.merged(list(buffer)):
                    end = at + len(token.removesuffix(END))
                    if end > len(buffer) - keep:
                        break
                    yield token
                    at = end
                buffer = buffer[at:]
                room = max(64, keep) if at else room * 2
        yield from self.merged(buffer)

    def word(self, piece: str) -> tuple[bytes, str]:
        """A piece's ids as unsigned 32-bit integers, and its tokens joined by a space."""
        symbols = self.symbols
        parts = [symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        parts[-1] += END
        tokens = self.merged(parts) if len(parts) <= _SHORT else list(self.transduce(parts))
        return struct.pack(f"<{len(tokens)}I", *map(self.ids.__getitem__, tokens)), " ".join(tokens)

    def normal(self, text: str) -> str:
        """NFC and lower case sign by sign: a final sigma has no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> tuple[list[bytes], list[str]]:
        """Ids and tokens, as ``word`` gives them, of the pieces of a text."""
        ids: list[bytes] = []
        tokens: list[str] = []
        known = self.known
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                tokens.append(part)
                continue
            for piece in self.pieces.findall(self.normal(part)):
                found = known.get(piece)
                if found is None:
                    found = self.word(piece)
                    if len(piece) <= _SHORT:
                        if len(known) >= _CACHE:
                            known.clear()
                        known[piece] = found
                ids.append(found[0])
                tokens.append(found[1])
        return ids, tokens

    # -- decoding

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, id by id; word ends become spaces, broken bytes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.plain[i])
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes where the file names no decoder: tokens, joined by a space."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text, others = batch.column("text"), [i for i, n in enumerate(batch.schema.names) if n != "text"]
            for start in range(0, len(batch), 256):
                rows = [bpe.encode(x.as_py() or "") for x in text[start : start + 256]]
                part = batch.slice(start, len(rows))
                packed = [b"".join(i) for i, _ in rows]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in others] + [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())], [batch.schema.names[i] for i in others] + ["ids", "n_tokens"])

    return run


def _schema(df: DataFrame, without: str, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != without] + [more])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The table with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens`` instead of ``text``."""
    return docs.mapInArrow(_encoded(path or tokenizer_path()), _schema(docs, "text", "ids binary, n_tokens long"))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, others = batch.column("ids"), [i for i, n in enumerate(batch.schema.names) if n != "ids"]
            texts = ["".join(bpe.text(x for (x,) in struct.iter_unpack("<I", i.as_py()))) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in others] + [pa.array(texts, pa.string())], [batch.schema.names[i] for i in others] + ["text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The table with ``text`` instead of ``ids``: lower case, one space after each word."""
    return encoded.mapInArrow(_decoded(path or tokenizer_path()), _schema(encoded, "ids", "text string"))


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for packed in batch.column("ids"):
                packed = packed.as_py()
                decoded = bpe.decode(memoryview(packed).cast("I"))
                rows.append((hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """op8: digests of every whole text's ids, and of what they decode to."""
    path = path or tokenizer_path()
    return encode(docs.select("doc_id", "text"), path).mapInArrow(_digested(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_stage(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: every document's ids."""
    encoded = encode(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
