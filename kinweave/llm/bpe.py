"""BPE encoding and decoding: merges are picked by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import arrow_rows, read, text_or_empty

#: White space as the tokenizer file's regular expressions mean it.
SPACE = r"\t-\r \x85\xA0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The characters up to U+00FF, and which of them are letters and numbers. Texts of these alone are split by the plainer ``re``.
LATIN = "".join(map(chr, range(256)))
LETTERS, NUMBERS = (re.escape("".join(regex.findall(kind, LATIN))) for kind in (r"\p{L}", r"\p{N}"))
LATIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xA0{LETTERS}{NUMBERS}]+"
NEVER = 1 << 62
#: Children of a node of the segment tree.
SHIFT = 4
FAN = 1 << SHIFT


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, others follow U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` after all merges, lowest rank first and leftmost among equals.

    The leaf of position i holds ``rank * n + i`` of the pair that starts there, so the root is at once the lowest rank and
    its leftmost place. A node has up to FAN children: a merge changes three leaves, and each costs one node a level.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    leaves = [found[0] * n + i if (found := get(p)) else NEVER for i, p in enumerate(zip(ids, ids[1:], strict=False))]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, upper = levels[-1], levels[1:]
    ids, following, before = [*ids], [*range(1, n), -1], [-1, *range(n - 1)]
    while (root := min(top)) < NEVER:
        i = root % n
        j = following[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        ids[j] = -1
        following[i] = after = following[j]
        changed = [i]
        if j < n - 1:
            leaves[j] = NEVER
            changed.append(j)
        if after >= 0:
            before[after] = i
            found = get((ids[i], ids[after]))
            leaves[i] = found[0] * n + i if found else NEVER
        else:
            leaves[i] = NEVER
        if (h := before[i]) >= 0:
            found = get((ids[h], ids[i]))
            leaves[h] = found[0] * n + h if found else NEVER
            changed.append(h)
        if upper:
            for k in changed:
                below = leaves
                for level in upper:
                    k >>= SHIFT
                    least = min(below[k << SHIFT : (k + 1) << SHIFT])
                    if level[k] == least:
                        break
                    level[k] = least
                    below = level
    return [x for x in ids if x >= 0]


def merge_node(ids: list[int], after: list[dict[int, int]], size: int) -> list[int]:
    """As ``merge``, for pairs that fit one node, which is the whole tree.

    A merged pair's leaf leaves the node, so the place of a leaf is that of its pair. ``after[a][b]`` is ``rank * size + merged``
    of a pair, so the root says as well what the pair becomes. A last leaf stands for the end.
    """
    ids = [*ids, -1]
    leaves = [after[a].get(b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    while (root := min(leaves)) < NEVER:
        i = leaves.index(root)
        x = ids[i] = root % size
        del ids[i + 1], leaves[i]
        leaves[i] = after[x].get(ids[i + 1], NEVER)
        if i:
            leaves[i - 1] = after[ids[i - 1]].get(x, NEVER)
    ids.pop()
    return ids


class Memo(dict):
    """What ``make`` gives for a word. Words met lately are kept, ``most`` at most: the younger half here, the older one in ``older``."""

    def __init__(self, make: Callable[[str], tuple[str, str]], most: int):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word) or self.make(word)
        if len(word) <= 64:
            self[word] = out
        return out


@dataclass
class Bpe:
    """A word-end BPE vocabulary with ``encode`` and ``decode``; words met before are kept in a bounded memo."""

    vocabulary: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str = "</w>"
    memo_words: int = 200_000

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(self.merges):
            self.pairs.setdefault((v[a], v[b]), (rank, v[a + b]))
        self.size, nothing = max(v.values()) + 1, {}
        self.after: list[dict[int, int]] = [nothing] * self.size
        for (a, b), (rank, merged) in self.pairs.items():
            if self.after[a] is nothing:
                self.after[a] = {}
            self.after[a][b] = rank * self.size + merged
        shown = byte_characters()
        self.inner = [v.get(c) for c in shown]
        self.last = [v.get(c + self.suffix) for c in shown]
        self.token = {i: t for t, i in v.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.token}
        self.pieces, self.latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.memo = Memo(self.entry, self.memo_words)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]}, model["end_of_word_suffix"])

    def word(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        if 0 < len(ids) <= FAN + 1:
            return merge_node(ids, self.after, self.size)
        return merge(ids, self.pairs)

    def entry(self, piece: str) -> tuple[str, str]:
        """The ids and the decoded form of a word, joined by spaces."""
        ids = self.word(piece)
        return " ".join([self.digits[i] for i in ids]), self.decode(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            # Each character is lower-cased by itself: a final sigma isn't told apart.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(text)
        return self.latin.findall(text)

    def parts(self, text: str) -> list[tuple[str, str]]:
        """The entries of a text's words and special tokens; words without tokens have two empty strings."""
        out, known = [], self.memo.__getitem__
        for part in self.marks.split(text) if self.marks and "<|" in text else (text,):
            if part in self.special:
                out.append((str(self.special[part]), part))
            else:
                out += map(known, self.split(part))
        return out

    def joined(self, text: str) -> tuple[int, str, str]:
        """Number of tokens of a text, their ids and their decoded form, joined by spaces."""
        parts = [p for p in self.parts(text) if p[0]]
        ids = " ".join([p[0] for p in parts])
        return ids.count(" ") + 1 if ids else 0, ids, " ".join([p[1] for p in parts])

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.joined(text)[1].split())]

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer file has no decoder: the tokens joined by one space."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """A worker process keeps its tokenizer, and the words that it has met, from task to task."""
    return Bpe.load(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids and the decoded text.

    A null text is taken as empty: no tokens, digests of the empty string. Rows are neither joined nor moved; repeated rows
    and null keys stay as they are, and other columns aren't read.
    """
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def make():
        bpe = loaded(path)

        def step(batch):
            out = {n.split()[0]: [] for n in schema.split(", ")} | {"key": batch.column(0)}
            for t in batch.column(1):
                n, ids, decoded = bpe.joined(t.as_py())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    out["ids"].append([*map(int, ids.split())])
                    out["decoded"].append(decoded)
            return out

        return step

    return arrow_rows(docs.select(docs[key].cast("long"), text_or_empty(text)), make, schema).withColumnRenamed("key", key)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
