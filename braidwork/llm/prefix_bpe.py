"""Byte-level BPE by prefix dynamic programming, and decoding.

A byte string has one encoding, so each of its prefixes has one last token. A token that ends at a place is that one if it
may follow the last token of the prefix before it, and two tokens may follow each other if merging their joined bytes gives
just them again. So the table of last tokens is filled from left to right in steps that look back over one token's length
at most: appends go on where the table ends, and after an edit the old entries hold before it, and again from where so many
entries in a row as the longest token has bytes are the old ones. The merge rule itself only ever sees two tokens' bytes.

Texts are cut into pieces by the vocabulary's pattern, and equal pieces are encoded once a worker (the memory of them is
bounded). Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm.common import numbered, table, text_or_empty

#: Pieces up to so many characters are remembered, so many of them, and so many pairs of tokens.
SHORT, REMEMBERED, PAIRS = 64, 300_000, 1_000_000


class Vocabulary:
    """Tokens and their ranks (their ids): a dict of bytes to int that holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.ending = ahocorasick.Automaton()  # of tokens that merging makes, bytes as the first 256 characters
        for token, i in ranks.items():
            if self.merged(token) == [i]:
                self.ending.add_word(token.decode("latin-1"), i)
        self.ending.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the rule that defines it: join the neighbours of least rank, the leftmost first, until none can be joined."""
        none = 1 << 40
        known = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [known(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = known(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = known(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def last_tokens(self, data: bytes, before: list[int]) -> list[int]:
        """The last tokens of the prefixes of data that end behind its first len(before) bytes, whose own are before.

        Where data is not the whole, it must begin a longest token's length or more before the first that is asked for.
        """
        last, known, sizes, done = before + [-1] * (len(data) - len(before)), self.pairs.get, self.sizes, len(before)
        for end, token in self.ending.iter(data.decode("latin-1")):  # ends go up; all tokens that end there come in a row
            if end >= done and last[end] < 0:
                at = end - sizes[token]
                if at < 0:
                    last[end] = token
                else:
                    valid = known(last[at] << 32 | token)
                    if valid or (valid is None and self.may_follow(last[at], token)):
                        last[end] = token
        return last[done:]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class Prefixes:
    """The bytes of one piece and, for each prefix, its last token. Piece-wide shortcuts of a vocabulary's own are not taken here."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), array("I")
        self.append(data)

    def _fill(self, stop: int) -> None:
        """Entries up to prefix length stop, from the first that is missing."""
        done = len(self.last)
        start = max(0, done - 2 * self.vocabulary.longest)  # tokens that begin before can't end behind done
        self.last.extend(self.vocabulary.last_tokens(bytes(self.data[start:stop]), self.last[start:].tolist()))

    def append(self, data: bytes) -> None:
        """Exact: entries of the prefixes there are stay as they are."""
        self.data += data
        self._fill(len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts data in place of the bytes from start to stop. Returns how many entries were computed."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("the edit lies outside")
        old, shift, longest = self.last, start + len(data) - stop, self.vocabulary.longest
        self.data[start:stop] = data
        self.last = old[:start]
        edited, same = start + len(data), 0
        ahead = 0
        while len(self.last) < len(self.data) or ahead:
            if not ahead:
                ahead = min(64, len(self.data) - len(self.last))
                self._fill(len(self.last) + ahead)
            at, ahead = len(self.last) - ahead + 1, ahead - 1
            # Behind the edit, an entry follows from the entries and bytes of one token's length before it.
            same = same + 1 if at > edited and self.last[at - 1] == old[at - shift - 1] else 0
            if same >= longest:
                made = at - start
                self.last[at:] = old[at - shift :]
                return made
        return len(self.data) - start

    def tokens(self) -> array:
        out, end, bytes_of = array("I"), len(self.last), self.vocabulary.bytes_of
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(bytes_of[token])
        out.reverse()
        return out


def stand_ins() -> dict[int, str]:
    """Code points that the regex library takes for letters, numbers or neither, but tiktoken's for something else, as the two know
    different versions of Unicode: with a character each that both take for what tiktoken does."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    plain = {bytes([b]): b for b in range(256)}
    table = dict.fromkeys(every, "\ue000")
    differ: set[str] = set()
    for kind, shown in ((r"\p{L}", "α"), (r"\p{N}", "²"), (r"\s", "\u3000")):
        library = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=plain, special_tokens={})  # it drops what its pattern does not match
        theirs = bytes(library.encode_ordinary(every)).decode()
        table |= dict.fromkeys(theirs, shown)
        differ |= set(theirs) ^ set(regex.findall(kind, every))
    return {ord(c): table[c] for c in differ}


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes; ids(text) -> those of a text, as tiktoken gives them without special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.pattern, self.table = vocabulary, regex.compile(pattern), stand_ins()
        self.older: dict[str, bytes] = {}
        self.cut, self.same = self.pattern.findall, frozenset(map(chr, self.table)).isdisjoint

    def shown(self, text: str) -> str:
        """The text as the pattern is to see it: of the same length, and nearly always the same."""
        return text if text.isascii() or self.same(text) else text.translate(self.table)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)  # a piece that is a token is that token, even if merging would not make it
            ids = (array("I", [whole]) if whole is not None else Prefixes(self.vocabulary, data).tokens()).tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)  # what is still met moves over from there
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        shown = self.shown(text)
        if shown is text:
            return b"".join(map(self.__getitem__, self.cut(text)))
        return b"".join(self[text[m.start() : m.end()]] for m in self.pattern.finditer(shown))


class Text:
    """A text that is kept encoded while it is appended to and edited: pieces that a change can't reach keep their tokens.

    A piece depends on the characters up to one behind its end, or three from its start where these are more (the endings
    of the pattern after an apostrophe). Pieces are found anew from the first that an edit can reach, until one begins behind
    the edit where an old one did. The pattern must not look back. The piece that begins like the old one keeps the table of
    its prefixes as far as the bytes agree, so appends inside a long piece go on where its table ends.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.shown, self.starts, self.made, self.tables = encoder, "", "", [], [], {}
        self.edit(0, 0, text)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Puts new in place of the characters from start to stop; returns how many pieces were encoded."""
        old, ends = self.text, [*self.starts[1:], len(self.text)][: len(self.starts)]
        first = next((i for i, (s, e) in enumerate(zip(self.starts, ends, strict=True)) if max(e + 1, s + 3) > start), len(self.starts))
        self.text = old[:start] + new + old[stop:]
        self.shown = self.shown[:start] + self.encoder.shown(new) + self.shown[stop:]
        at = self.starts[first] if first < len(self.starts) else len(old)
        shift, edited = start + len(new) - stop, start + len(new)
        behind = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        starts, made, tables, found = self.starts[:first], self.made[:first], {s: t for s, t in self.tables.items() if s < at}, 0
        while at < len(self.text):
            if at >= edited and at in behind:
                i = behind[at]
                starts += [s + shift for s in self.starts[i:]]
                made += self.made[i:]
                tables |= {s + shift: t for s, t in self.tables.items() if s >= at - shift}
                break
            piece = self.text[at : self.encoder.pattern.match(self.shown, at).end()]
            starts.append(at)
            made.append(self._piece(piece, at, tables, self.tables.get(at) if at < start else None))
            at, found = at + len(piece), found + 1
        self.starts, self.made, self.tables = starts, made, tables
        return found

    def _piece(self, piece: str, at: int, tables: dict[int, Prefixes], known: Prefixes | None) -> bytes:
        data = piece.encode()
        if len(piece) <= SHORT or data in self.encoder.vocabulary.ranks:
            return self.encoder[piece]
        if known is None:
            known = Prefixes(self.encoder.vocabulary, data)
        else:
            was, n, m = bytes(known.data), 0, 0
            top = min(len(was), len(data))
            while n < top and was[n] == data[n]:
                n += 1
            while m < top - n and was[-1 - m] == data[-1 - m]:
                m += 1
            known.replace(n, len(was) - m, data[n : len(data) - m])
        tables[at] = known
        return known.tokens().tobytes()

    def append(self, new: str) -> int:
        return self.edit(len(self.text), len(self.text), new)

    def ids(self) -> bytes:
        return b"".join(self.made)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (lines of a token in base 64 and its rank), read once a worker."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encoders[path, pattern] = Encoder(Vocabulary(ranks), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]): the tokens of each text, and the digest of what they decode to.

    ids are little-endian unsigned 32-bit bytes. A null text is an empty one: no tokens. Each row is encoded for itself, so
    repeated rows agree; rows with a null key stay. Other columns are not carried, whatever their names. Very long texts and
    very long pieces take time and memory in proportion. No rows give none.
    """
    import pyarrow as pa

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    plain, name = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        known = encoder(str(path), pattern)
        decode = known.vocabulary.decode
        for batch in batches:
            counts, digests, decoded, kept = array("q"), [], [], []
            for text in batch.column(1):
                ids = known.ids(text.as_py())
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = {"key_": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    fields = f"key_ {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return plain.select(plain[name[key]].alias("key_"), text_or_empty(name[text]).alias("text_")).mapInArrow(run, fields).withColumnRenamed("key_", key)


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
