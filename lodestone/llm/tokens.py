"""Byte-level BPE of whole texts, and token counts by the whole-token shortcut.

Offline (once, on the driver), every vocabulary string is encoded by itself;
those that the library gives back as exactly one token form the whole-token
table, bounded by the vocabulary.  A text is cut into pre-tokens; a pre-token
in the table is one token, and only the rest goes through the merges,
each distinct one once per worker process as long as a bounded cache holds it.

The cut is done by the vocabulary's own pattern.  It is used where Unicode
versions cannot disagree (letters of common scripts, digits and punctuation,
`SAFE`).  A text with other characters is parted where a blank stands between
two safe characters, which the pattern always cuts: runs of safe words are
counted here, the words between them go through the library.  A text with the
string of a special token goes through the library as a whole.  Results are
those of the library in every case.

Defined results: a null text is empty and has 0 tokens; special strings inside
a text become their special token, as the library does by default; rows are
handled one by one, whatever their ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import worker_cache

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the same kind (letter, digit, white space, other) in every version of Unicode that libraries use:
#: ASCII, Latin, general punctuation, Greek, Cyrillic, Hebrew, Arabic, Kana, ideographs, Hangul and their punctuation.
BLANKS, SIGNS = r"\t\n\r\x20", r"\x21-\x7e\xa1-\xac\xae-ɏ‐-‧‰-›€™ΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁҊ-ӿא-תء-غف-ي、-〃〈-】ぁ-ゖァ-ヺー一-龥가-힣！-？"
SAFE = f"[{BLANKS}{SIGNS}]*"
#: Places where every text may be parted: before a blank between two safe characters.
PARTS = f"(?<=[{SIGNS}])(?= [{SIGNS}])"
CACHE_ENTRIES = 400_000
TOKEN_LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    strings = sorted({t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())} - special)
    strings = [s for s in strings if s and "�" not in s and regex.fullmatch(SAFE, s) and regex.findall(PATTERN, s) == [s]]
    return {s: e.ids[0] for s, e in zip(strings, t.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1}


def byte_ranks(path: str) -> dict[bytes, int]:
    """The ordinary vocabulary as bytes, from the file's printable spelling.

    Printable bytes stand for themselves; the others, in order, for the
    characters from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data["added_tokens"]}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


class Encoder:
    """Encodes texts with one vocabulary file as the library does."""

    def __init__(self, path: str, whole: dict[str, int]):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.cut, self.safe, self.parts = regex.compile(PATTERN).findall, regex.compile(SAFE).fullmatch, regex.compile(PARTS)
        self.special = regex.compile("|".join(map(regex.escape, special))).search if special else lambda text: None
        # The same merges, without the library's cost for each call.
        self.merges = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
        self.whole, self.known = whole, dict.fromkeys(whole, 1)

    def _runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text in runs that the pattern cuts here, or that the library must encode."""
        if self.special(text) is not None:
            yield False, text
            return
        if self.safe(text) is not None:
            yield True, text
            return
        cuts = [0, *(m.start() for m in self.parts.finditer(text)), len(text)]
        begin, kind = 0, None
        for s, e in zip(cuts, cuts[1:]):
            safe = self.safe(text, s, e) is not None
            if kind is not None and safe != kind:
                yield kind, text[begin:s]
                begin = s
            kind = safe
        yield bool(kind), text[begin:]

    def _learn(self, pieces: list[str]) -> None:
        """Counts the merges of pre-tokens that aren't whole tokens, once each."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = dict.fromkeys(self.whole, 1)
        known, merge = self.known, self.merges._core_bpe.encode_single_piece
        for p in set(pieces):
            if p not in known:
                known[p] = len(merge(p.encode()))

    def count(self, text: str) -> int:
        return sum(self._counted(x) if safe else len(self.library.encode(x, add_special_tokens=False).ids) for safe, x in self._runs(text))

    def _counted(self, text: str) -> int:
        pieces = self.cut(text)
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return sum(map(self.known.__getitem__, pieces))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for safe, x in self._runs(text):
            out += self.merges.encode_ordinary(x) if safe else self.library.encode(x, add_special_tokens=False).ids
        return out


def worker_encoder(path: str, whole=None) -> Encoder:
    held, key = worker_cache("encoders"), (path, whole is not None)
    if key not in held:
        held[key] = Encoder(path, whole.value if whole is not None else {})
    return held[key]


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; no shuffle."""
    path = path or default_vocabulary()
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, whole)
        for b in batches:
            texts = b.column(1)
            n = pa.array([encoder.count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.compute.cast(pa.compute.binary_length(texts), pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

    out = narrow.mapInArrow(counted, f"doc_id {id_type}, n_tokens bigint, n_bytes bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
