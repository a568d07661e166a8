"""Byte-level word BPE, encoded by dynamic programming over prefixes, and decoded.

For every prefix of a word there is one token that its encoding ends with. An automaton over the vocabulary lists the
tokens that are a suffix of each prefix; a token is the one sought if it is compatible with the last token of the
prefix before it, that is, if encoding the two tokens' text gives just these two tokens. Following the stored tokens
back from the whole word gives exactly the ids that merging by rank gives.

Reads a `tokenizers` JSON file whose model is BPE with an end-of-word suffix; its path is a parameter.

Defined results:
- text null or empty: no ids, decoded text empty
- a word of any length is encoded in time linear in its length; only words of up to MEMO_CHARS are remembered
- strings of special tokens in a text are those tokens, as in the library
- repeated rows and null ids: each row is encoded on its text alone
- columns of the input named like an output column are replaced; all others are carried along
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import struct
import sys
from array import array

from pyspark.sql import DataFrame

from weftline.llm.common import append_columns

#: Words that a task remembers, in each of two generations, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
#: Verdicts on pairs of tokens, and steps of the automaton, that a task remembers.
MOST_FITS, MOST_STEPS = 500_000, 200_000
#: Below this code point canonical composition changes nothing and both libraries' character classes agree.
PLAIN_BELOW = 0x300
#: Marks of which any run is one pre-token by itself; a word and such a run are two.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A full stop or comma beside another mark, below PLAIN_BELOW; others are pre-tokens by themselves.
BESIDE_MARKS = re.compile(rf"[.,](?:(?=[{(_ := ''.join(re.escape(chr(i)) for i in range(0x21, PLAIN_BELOW) if not chr(i).isalnum() and not chr(i).isspace()))}])|(?<=[{_}].))")
#: A word of up to so many letters is remembered together with the mark after it; longer ones are put together anew.
SHORT_WORD = 5
START = 1 << 30  # stands for the token before the first
END = "\x00"  # ends a word inside the automaton; byte-level alphabets hold no control characters


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(others)) for b in range(256)]


class SuffixAutomaton:
    """The tokens that are suffixes of what has been read, longest first.

    A trie of the tokens with, for every state, the state of its longest suffix that is in the trie. A step that the trie lacks
    is taken from that suffix and remembered, so the next one costs a single look-up; a state's tokens are listed with it.
    """

    def __init__(self):
        self.steps: list[dict[str, int]] = [{}]
        self.suffix: list[int] = [0]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.remembered = 0

    def add(self, text: str, token: int) -> None:
        state = 0
        for c in text:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = len(self.steps)
                self.steps.append({})
                self.suffix.append(0)
                self.ends.append(())
            state = after
        self.ends[state] = ((token, len(text)),)

    def link(self) -> None:
        """After the last token: suffix states level by level, so that a shorter text's is known before a longer one's."""
        level = [(0, c, after) for c, after in self.steps[0].items()]
        while level:
            below = []
            for parent, c, state in level:
                below += [(state, x, after) for x, after in self.steps[state].items()]
                at = self.suffix[parent]
                while parent and c not in self.steps[at] and at:
                    at = self.suffix[at]
                self.suffix[state] = self.steps[at].get(c, 0) if parent else 0
                self.ends[state] += self.ends[self.suffix[state]]
            level = below

    def step(self, state: int, c: str) -> int:
        """A step that the trie lacks."""
        at = state
        while at and c not in self.steps[at]:
            at = self.suffix[at]
        after = self.steps[at].get(c, 0)
        if self.remembered < MOST_STEPS:
            self.remembered += 1
            self.steps[state][c] = after
        return after


class WordBpe:
    """The encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: BPE with an end-of-word suffix over lower-cased text is expected")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as the machine's unsigned 32-bit integers, little end first")
        self.library = Tokenizer.from_file(path)
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # str.split() takes the separators U+001C to U+001F for white space, the file's pattern does not
        self.exotic = re.compile(f"[^\\x00-\\u{PLAIN_BELOW - 1:04x}]|[\\x1c-\\x1f]")
        self.separators = "\x1c\x1d\x1e\x1f"
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(vocab.values(), -1)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merged, ids = vocab[left + right], (vocab[left], vocab[right])
            self.merge_rank[ids] = rank
            self.rank[merged], self.parts[merged] = rank, ids
        self.fits: dict[int, dict[int, bool]] = {i: {} for i in vocab.values()}
        self.n_fits = 0
        self.whole: dict[int, bool] = {}
        self.automaton = SuffixAutomaton()
        for text, i in vocab.items():
            if self.reachable(i):
                inner = text.removesuffix(suffix)
                self.automaton.add(inner + END * (text != inner), i)
        self.automaton.link()
        self.fits[START] = dict.fromkeys(vocab.values(), True)  # any token may come first
        self.memo, self.ids = _Memo(self, {}), _Ids(self, {})

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a and b, put together, is encoded as a and b.

        The merges that made a and b are undone from the last one backwards, always on the side whose token came later.
        If the two tokens that then meet would have merged before the merge undone last, the pair cannot stand.
        Of equal merges the left one comes first.
        """
        key, rank, before, found = (a, b), self.rank, len(self.merge_rank), True
        while True:
            if self.merge_rank.get((a, b), before) < before:
                found = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:
                before, a = rank[a], self.parts[a][1]
            else:
                before, b = rank[b] + 1, self.parts[b][0]
        if self.n_fits >= MOST_FITS:
            for left, row in self.fits.items():
                if left != START:
                    row.clear()
            self.n_fits = 0
        self.n_fits += 1
        self.fits[key[0]][key[1]] = found
        return found

    def reachable(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token."""
        found = self.whole.get(token)
        if found is None:
            found = True
            if self.rank[token] >= 0:
                a, b = self.parts[token]
                # the first merge that the two parts' meeting edges would make must be the token's own
                found = self.reachable(a) and self.reachable(b) and self._meets(a, b, self.rank[token])
            self.whole[token] = found
        return found

    def _meets(self, a: int, b: int, own: int) -> bool:
        """Whether nothing merges across a and b before the merge of rank own."""
        rank, before = self.rank, own
        while True:
            crossing = self.merge_rank.get((a, b), own)
            if crossing < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = min(own, rank[a]), self.parts[a][1]
            else:
                before, b = min(own, rank[b] + 1), self.parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token, written in the byte alphabet."""
        n, fits, compatible = len(word), self.fits, self.compatible
        steps, ends, step = self.automaton.steps, self.automaton.ends, self.automaton.step
        # by prefix length, the word's end counting as one more: the encoding's last token and that token's length
        last, size = [-1] * (n + 2), [0] * (n + 2)
        last[0], end, state = START, 0, 0
        for c in word[:-1]:
            end += 1
            after = steps[state].get(c)
            state = step(state, c) if after is None else after
            for token, length in ends[state]:
                before = last[end - length]
                if before >= 0:
                    found = fits[before].get(token)
                    if compatible(before, token) if found is None else found:
                        last[end], size[end] = token, length
                        break
        # the whole word without its end is not looked for
        for c in word[-1:] + END:
            after = steps[state].get(c)
            state = step(state, c) if after is None else after
        end = n + 1
        for token, length in ends[state]:
            before = last[end - length]
            if before >= 0 and (fits[before][token] if token in fits[before] else compatible(before, token)):
                last[end], size[end] = token, length
                break
        if last[end] < 0:
            raise ValueError(f"no token of the vocabulary ends {word!r}")
        ids, at = [], n + 1
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word  # without white space, as pre-tokens are, visible ASCII stands for itself
        alphabet = self.alphabet
        return "".join([alphabet[b] for b in word.encode("utf-8")])

    def plain(self, text: str) -> bool:
        """Whether nothing in the text is exotic. ASCII and Latin-1 texts are known without looking at each character."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.exotic.search(text) is None
        return not any(c in text for c in self.separators)

    @staticmethod
    def runs(text: str) -> list[str]:
        """The lower-cased runs of a plain text between white space; full stops and commas are runs of their own where they stand
        alone in the whole text, so that words are remembered without them."""
        low = text.lower()
        if BESIDE_MARKS.search(low) is None:
            low = low.replace(".", " . ").replace(",", " , ")
        return low.split()

    def _pieces(self, text: str):
        """(packed ids, decoded text) of each run of pre-tokens."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.older, self.memo = None, _Memo(self, self.memo)
        if not self.plain(text):
            inner = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [self.entry(word) for word, _ in inner]
        return list(map(self.memo.__getitem__, self.runs(text)))

    def entry(self, mapped: str) -> tuple[bytes, str]:
        ids = self.encode_word(mapped)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def pieces(self, text: str | None):
        if not text:
            return []
        if self.specials is None or not any(s in text for s in self.special):
            return self._pieces(text)
        found = []
        for part in self.specials.split(text):
            if part in self.special:
                found.append((struct.pack("<I", self.special[part]), part))
            elif part:
                found += self._pieces(part)
        return found

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        if not text:
            return b""
        if self.specials is not None and any(s in text for s in self.special) or not self.plain(text):
            return b"".join([ids for ids, _ in self.pieces(text)])
        if len(self.ids) > MEMO_WORDS:
            self.ids.older, self.ids = None, _Ids(self, self.ids)
        return b"".join(map(self.ids.__getitem__, self.runs(text)))

    def encode(self, text: str | None) -> list[int]:
        packed = self.packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids) -> str:
        """Without a decoder in the file, tokens are joined by spaces, as the library does."""
        return " ".join([self.token[i] for i in ids if i in self.token])


class _Memo(dict):
    """Entries by lower-cased run of other than white space; no pre-token spans white space."""

    def __init__(self, bpe: WordBpe, older: dict):
        self.bpe, self.older = bpe, older

    def __missing__(self, run: str) -> tuple[bytes, str]:
        stem = run.rstrip(MARKS)
        if stem and len(stem) < len(run) and stem.isalpha():
            (a, x), (b, y) = self[stem], self[run[len(stem) :]]
            found = a + b, f"{x} {y}"
            if len(stem) > SHORT_WORD and len(run) == len(stem) + 1:
                return found
        else:
            found = self.older.get(run)
            if found is None:
                if run.isalpha():
                    found = self.bpe.entry(self.bpe.mapped(run))
                else:
                    inner = [self.bpe.entry(self.bpe.mapped(w)) for w in self.bpe.words.findall(run)]
                    found = b"".join([ids for ids, _ in inner]), " ".join([text for _, text in inner])
        if len(run) <= MEMO_CHARS:
            self[run] = found
        return found


class _Ids(dict):
    """Packed ids alone, by lower-cased run of other than white space, for callers that need no decoded text."""

    def __init__(self, bpe: WordBpe, older: dict):
        self.bpe, self.older = bpe, older

    def __missing__(self, run: str) -> bytes:
        stem = run.rstrip(MARKS)
        if stem and len(stem) < len(run) and stem.isalpha():
            found = self[stem] + self[run[len(stem) :]]
            if len(stem) > SHORT_WORD and len(run) == len(stem) + 1:
                return found
        else:
            found = self.older.get(run)
            if found is None:
                words = [run] if run.isalpha() else self.bpe.words.findall(run)
                found = b"".join([array("I", self.bpe.encode_word(self.bpe.mapped(w))).tobytes() for w in words])
        if len(run) <= MEMO_CHARS:
            self[run] = found
        return found


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each process and file. Its tables live as long as the process: the collector need not visit them."""
    made = WordBpe(path)
    gc.freeze()
    return made


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, digest_only: bool = False) -> DataFrame:
    """Add n_tokens, ids and decoded, or with digest_only their digests ids_sha256 and decoded_sha256."""
    outputs = [("n_tokens", "long")] + ([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest_only else [("ids", "array<long>"), ("decoded", "string")])

    def make():
        bpe = load(path)

        def work(texts):
            counts, first, second = [], [], []
            for text in texts:
                pieces = bpe.pieces(text)
                packed, decoded = b"".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])
                counts.append(len(packed) // 4)
                first.append(hashlib.sha256(packed).hexdigest() if digest_only else list(struct.unpack(f"<{len(packed) // 4}I", packed)))
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest_only else decoded)
            return counts, first, second

        return work

    return append_columns(docs, [text_col], outputs, make, keep)
