"""Exact BPE by dynamic programming over prefixes.

The BPE encoding of a word restricts to the encoding of each of its prefixes up to the last
token, and a row of tokens is the encoding of its text exactly if every two neighbours are:
merges across a border depend on the two tokens at the border alone. So each prefix has one
last token that fits: the longest-first candidate among the tokens ending there (found for
all positions in one run of an automaton over the vocabulary) that is compatible with the
last token of the prefix before it. Following the last tokens back from the end of the word
gives the ids. The work is linear in the word, whatever its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.common import query, table

#: Marks the end of a word inside the automaton; no byte symbol is this character.
END = "\0"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable bytes stand for themselves, the others
    are numbered from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PrefixEncoder:
    """Encoder of single words for a merge list with an optional end-of-word suffix."""

    def __init__(self, model: dict):
        import ahocorasick

        self.suffix = model.get("end_of_word_suffix") or ""
        self.fitting: dict[int, bool] = {}
        vocab = model["vocab"]
        self.born, self.parts, self.rank, self.known_whole = {}, {}, {}, {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.rank.setdefault(pair, order)
            if made not in self.born:
                self.born[made], self.parts[made] = order, pair
        self.matches = ahocorasick.Automaton()
        for token, number in vocab.items():
            if number not in self.born:
                self.born[number] = -1
            body = token
            if self.suffix and token.endswith(self.suffix) and token != self.suffix:
                body = token[: -len(self.suffix)] + END
            if (self.born[number] >= 0 or len(body.rstrip(END)) == 1) and self._whole(number):
                self.matches.add_word(body, (number, len(body.rstrip(END))))
        self.matches.make_automaton()

    def _whole(self, number: int) -> bool:
        """Whether the token's own text encodes to the token: both parts are whole, and nothing
        across their border comes before the merge that makes the token."""
        if number not in self.known_whole:
            self.known_whole[number] = self.born[number] < 0 or (
                all(map(self._whole, self.parts[number]))
                and self.fits(*self.parts[number], before=self.born[number])
            )
        return self.known_whole[number]

    def fits(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether ``left`` followed by ``right`` stays two tokens.

        Goes back in time from the two finished tokens: of the two symbols at the border the
        younger one is taken apart, and a merge across the border must not have come before
        the merge that used them up. Of equal merges the left one is done first.
        """
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing < before:
                return False
            age_left, age_right = self.born[left], self.born[right]
            if age_left < 0 and age_right < 0:
                return True
            if age_left > age_right:
                before, left = age_left, self.parts[left][1]
            else:
                before, right = age_right + 1, self.parts[right][0]

    def encode(self, symbols: str) -> list[int]:
        """Ids of one word, given as its byte symbols."""
        size = len(symbols)
        if not size:
            return []
        last: list[int | None] = [None] * (size + 1)
        back = [0] * (size + 1)
        fitting = self.fitting
        # The matches come by their ends, the longest first.
        for at, (number, length) in self.matches.iter(symbols + END if self.suffix else symbols):
            end = at + 1
            if self.suffix:
                if end == size:
                    continue  # the last symbol counts with the end of the word alone
                end = min(end, size)
            if last[end] is not None:
                continue
            start = end - length
            if start:
                before = last[start]
                if before is None:
                    continue
                pair = before << 32 | number
                fine = fitting.get(pair)
                if fine is None:
                    if len(fitting) >= 1 << 20:
                        fitting.clear()
                    fine = fitting[pair] = self.fits(before, number)
                if not fine:
                    continue
            last[end], back[end] = number, start
        if last[size] is None:
            raise ValueError("the vocabulary lacks a symbol of the text")
        out, end = [], size
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]


class WordTokenizer:
    """Text to ids and back, for lower-casing word BPE files: special tokens are cut out of the
    raw text, the rest is composed, lower-cased and split into words; white space is dropped.

    Letters, digits, white space and lower case are those of the tokenizers library, whose
    tables are of another Unicode version than Python's. Every character is tried on both once,
    when it is first met; a text with one on which they differ is composed and split by the
    library's own two steps.
    """

    #: Pieces of a run without white space, in Python's classes; no word spans white space.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"

    def __init__(self, path: str, cache: int = 400_000):
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = parts["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or parts["decoder"]:
            raise ValueError("this file needs another normaliser or decoder")
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer
        self.pieces = re.compile(self.PIECE).findall
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.encoder = PrefixEncoder(parts["model"])
        self.symbols = byte_symbols()
        self.text_of = {n: t for t, n in parts["model"]["vocab"].items()} | {n: t for t, n in special.items()}
        self.tried: set[str] = set()
        self.odd: set[str] = set()
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.cache = cache

    def _prepared(self, text: str) -> str:
        import unicodedata

        # Lower-casing goes letter by letter: a sigma doesn't depend on its place.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _shown(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode()])

    def _split(self, text: str) -> list[str]:
        """The words as byte symbols, by the library's own steps."""
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))]

    def _try(self, letters: set[str]) -> None:
        """Note on which of the letters Python and the library differ, among other letters of every class."""
        for letter in letters:
            probe = "".join(f"{a}{letter}{a} " for a in "aA1!'") + f"{letter}{letter} {letter}a {letter}1 {letter}s"
            ours = [self._shown(w) for run in self._prepared(probe).split() for w in self.pieces(run)]
            if ours != self._split(probe):
                self.odd.add(letter)
        self.tried |= letters

    def _symbol_ids(self, symbols: str) -> bytes:
        import array

        got = self.words.get(symbols)
        if got is None:
            if len(self.words) >= self.cache:
                self.words.clear()
            got = self.words[symbols] = array.array("i", self.encoder.encode(symbols)).tobytes()
        return got

    def _run(self, run: str) -> bytes:
        if len(self.runs) >= self.cache:
            self.runs.clear()
        got = self.runs[run] = b"".join([self._symbol_ids(self._shown(w)) for w in self.pieces(run)])
        return got

    def encode(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        import array
        import unicodedata

        letters = set(text)
        if not unicodedata.is_normalized("NFC", text):
            letters |= set(unicodedata.normalize("NFC", text))
        if fresh := letters - self.tried:
            self._try(fresh)
        out = []
        for piece in self.cut.split(text) if self.special else [text]:
            if piece in self.special:
                out.append(array.array("i", [self.special[piece]]).tobytes())
            elif letters.isdisjoint(self.odd):
                known = self.runs.get
                out += [known(run) or self._run(run) for run in self._prepared(piece).split()]
            else:
                out += map(self._symbol_ids, self._split(piece))
        return b"".join(out)

    def decode(self, ids) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def shared_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with the words it has met, per worker process and file, whichever task asks."""
    import sys
    import types

    held = vars(sys.modules.setdefault("word_tokenizers_of_this_process", types.ModuleType("held")))
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def tokenize(docs: DataFrame, text: str, path: str, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Add the ``ids`` of every whole text (array of int) and, decoded from them, ``decoded``.

    A null text is read as empty; an empty text has no ids and decodes to the empty text;
    repeated rows get equal results; an empty table stays empty; a clash with a new name
    raises; other columns are kept. Each worker process loads the file once; words seen are kept in
    a bounded cache. ``path`` must be readable by the executors.
    """
    new = [ids, *([decoded] if decoded else [])]
    if clash := {n.lower() for n in new} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokenizer = shared_tokenizer(path)
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(first, 256)
                encoded = [tokenizer.encode(v.as_py() or "") for v in batch.column(at)]
                flat = np.frombuffer(b"".join(encoded), np.int32)
                ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                if decoded:
                    numbers = flat.tolist()
                    columns.append(
                        pa.array([tokenizer.decode(numbers[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
                    )
                yield pa.RecordBatch.from_arrays(columns, names=[*whole_batch.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file of that name lies; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op6_prefix_bpe(spark, sf_dir):
    """Ids of every whole text and their decoded text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = tokenize(docs, "text", tokenizer_path("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
