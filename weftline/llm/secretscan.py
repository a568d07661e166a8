"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens are tagged as begin, inside or outside of a secret from their own shape, the words beside them and features of the
whole text, decoded by Viterbi. A field that learned only from what the patterns find could do no more than repeat them, so
it learns from a bounded sample of texts (SAMPLE_TEXTS by hashed id) in which secrets are planted: values of many makes,
behind many keywords and behind none, so that shape and neighbours must each do without the other; and, as often, things
that look alike and are none. Runs that it tags and that touch no pattern match are added with the kind `crf`.

Decoding is exact but skips what is settled: where a token's lead for outside is larger than all that transitions can
change, every best path passes outside there, so only the tokens between such places are decoded.

Defined results:
- text null or empty: no spans
- no text in the sample: an untrained field, which adds nothing
- positions are code points, ends exclusive; a span of the fixed patterns is the whole match
- several texts for one id: one of them is learned from
- repeated rows and null ids: each row is scanned on its text alone
- a text of any length is one row; its tokens are held by one task
- columns of the input named like an output column are replaced; all others are carried along, whatever their names
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import append_columns, sample_by_hash

SAMPLE_TEXTS = 800
#: Tokens on either side of a match that are learned from; the most windows of one sampled text, so that no text outweighs
#: the others in training; secrets and look-alikes planted into each text; rounds of training.
WINDOW, WINDOWS_OF_TEXT, PLANTED, ROUNDS = 14, 20, 2, 60
MEMO_TOKENS = 400_000
#: Steps of the lead that settled tokens are told apart by; letters of a word whose features follow from its length and capitals.
STEP, PLAIN_LENGTH = 0.5, 12
NOTHING = (False,) * 5
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# A greedy run that is too short is dropped whole, so asking for the length in the pattern finds the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Words that stand before secrets, alone or as a part of a name, beside those of the patterns.
HINTS = frozenset("password passwd passphrase pwd pass pin secret secrets token apikey api_key api key keys bearer authorization credential credentials creds auth access private client signature signing license webhook passwort kennwort schlüssel contraseña clave motdepasse".split())
#: How far before a token a hint still counts.
REACH = 4

TOKEN = re.compile(r"[\w+/\-]+|[^\w\s]")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str, distinct: set[str] | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind.

    distinct: the text's different tokens, if they are known; they tell without a look at the text that a pattern cannot match.
    """
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    # a run of hexadecimal digits is inside one token
    if distinct is None or max(map(len, distinct), default=0) >= HEX_LENGTH:
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


CLASSES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})
RUNS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """The token's classes of characters, runs once."""
    return RUNS.sub(r"\1", token.translate(CLASSES))


PARTS = re.compile(r"[_\-/+]")


def is_hint(token: str) -> bool:
    word = token.lower()
    return word in HINTS or any(c in word for c in "_-/") and not HINTS.isdisjoint(PARTS.split(word))


def own_features(token: str) -> list[str]:
    n = len(token)
    if token.isalpha():
        kind = "word:lower" if token.islower() else "word:title" if token.istitle() else "word:upper" if token.isupper() else "word:mixed"
        return ["len=" + str(min(6, n.bit_length())), kind] + (["hint"] if is_hint(token) else []) + (["vowels=" + str(int(4 * sum(c in "aeiouyAEIOUY" for c in token) / n))] if n > 12 else [])
    found = ["len=" + str(min(6, n.bit_length())), "shape=" + shape(token)[:8]]
    if n >= 6:
        digits, upper = sum(c.isdigit() for c in token), sum("A" <= c <= "Z" for c in token)
        counts = Counter(token)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        found += [f"entropy={int(2 * entropy)}", f"digits={int(4 * digits / n)}", f"upper={int(4 * upper / n)}", "switches=" + str(min(6, len(shape(token)) // 2))]
        if re.fullmatch(r"[0-9a-f]+", token):
            found.append("hex" if 0 < digits < n else "plain")
        if not token.isascii():
            found.append("wide")
        if digits == n:
            found.append("number")
        if digits + upper == n and digits and upper:
            found.append("capitals and digits")
        # words, numbers and short marks put together make a name; a secret has a long stretch of both
        longest = max((p for p in PARTS.split(token)), key=len)
        found.append(f"longest={min(6, len(longest).bit_length())}" + ("mixed" if not longest.isalpha() and not longest.isdigit() else "plain"))
    if is_hint(token):
        found.append("hint")
    return found


def beside_kind(token: str) -> str:
    """What a neighbour sees of a token."""
    return "hint" if is_hint(token) else "mark" + token if len(token) == 1 and not token.isalnum() else "number" if token.isdigit() else "other"


def beside_features(token: str, side: str) -> list[str]:
    return [side + beside_kind(token)]


def hint_features(token: str, distance: int) -> list[str]:
    return [f"hint-{distance}"] if is_hint(token) else []


def features_at(tokens: list[str], i: int, whole: list[str]) -> list[str]:
    """All features of a token; Scanner adds up the same from its table."""
    found = own_features(tokens[i]) + whole
    found += beside_features(tokens[i - 1], "before:") if i else []
    found += beside_features(tokens[i + 1], "after:") if i + 1 < len(tokens) else []
    for d in range(2, REACH + 1):
        found += hint_features(tokens[i - d], d) if i >= d else []
    return found


def file_features(tokens: list[str]) -> list[str]:
    n = max(1, len(tokens))
    return [f"file:marks={min(4, int(20 * (tokens.count('=') + tokens.count(':')) / n))}", f"file:quotes={min(4, int(20 * tokens.count(chr(34)) / n))}", "file:long" if n > 400 else "file:short"]


@dataclass(frozen=True)
class SecretField:
    """Weights by feature (begin, inside, outside) and between neighbouring tags."""

    weights: dict[str, tuple[float, float, float]]
    moves: np.ndarray

    def total(self, names: list[str]) -> np.ndarray:
        found = [self.weights[f] for f in names if f in self.weights]
        return np.sum(found, axis=0) if found else np.zeros(3)


def viterbi(emit: np.ndarray, moves: np.ndarray, before: int = OUTSIDE, after: int = OUTSIDE) -> list[int]:
    """The best tags for emit, between the fixed tags before and after."""
    score, back = emit[0] + moves[before], []
    for row in emit[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    tag = int((score + moves[:, after]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


def lead(vector: np.ndarray) -> float:
    """By how much outside is ahead."""
    return float(vector[OUTSIDE] - max(vector[BEGIN], vector[INSIDE]))


class Scanner:
    """Tags texts with one field.

    Most tokens are outside wherever they stand: beside ordinary neighbours (words, numbers, and marks that say no less for
    outside than these and than a full stop or comma) and without a hint before them, their own features are more than all
    that transitions can change. These are remembered as settled, by what the text's features as a file add (in steps of
    STEP). Looked at where they stand are the others, and those beside a mark or after a hint that is not ordinary. Of the
    others some, marks above all, could be inside of a secret but are none by themselves: between two settled tokens they are
    outside too.
    """

    def __init__(self, field: SecretField):
        self.field = field
        #: By step: tokens that are settled and change nothing beside them; what is known of the others; kinds of plain words.
        self.settled: dict[int, set[str]] = {}
        self.others: dict[int, dict[str, tuple]] = {}
        self.plain: dict[tuple, bool] = {}
        self.known: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.table = np.zeros((1024, 2 + REACH, 3))
        self.slack = 2 * float(field.moves.max() - field.moves.min())
        # the least that an ordinary token adds to the lead of outside after it and before it
        self.before, self.after = (min(lead(field.total([f"{side}:{kind}"])) for kind in ("other", "number", "mark.", "mark,")) for side in ("before", "after"))

    def unsettled(self, distinct: set[str], change: int) -> dict[str, tuple[bool, bool, bool, bool, bool]]:
        """The tokens that are not settled or change what stands beside them: (may be a secret, is none alone, changes the next
        one, changes the one before, is a hint)."""
        settled, others = self.settled.setdefault(change, set()), self.others.setdefault(change, {})
        found, done = {}, []
        for token in distinct - settled:
            held = others.get(token)
            if held is None:
                if token.isalpha() and len(token) <= PLAIN_LENGTH and token.lower() not in HINTS:
                    # a plain word's features follow from its length and capitals
                    kind = change, len(token).bit_length(), token.islower(), token.istitle(), token.isupper()
                    easy = self.plain.get(kind)
                    if easy is None:
                        easy = self.plain[kind] = not self.may_be_secret(token, change)
                    if easy:
                        done.append(token)
                        continue
                vectors = self.vectors(token)
                may = self.may_be_secret(token, change)
                held = may, may and self.is_none_alone(token, change), lead(vectors[1]) < self.before, lead(vectors[2]) < self.after, is_hint(token)
                if not (held[0] or held[2] or held[3] or held[4]):
                    done.append(token)
                    continue
                if len(others) > MEMO_TOKENS:
                    others.clear()
                others[token] = held
            found[token] = held
        if len(settled) + len(done) > MEMO_TOKENS:
            settled.clear()
        settled.update(done)
        return found

    def row(self, token: str) -> int:
        """A token's row of the table: what it adds as the one itself, as the one before, as the one after and as a hint further
        before. Tokens with the same features share one."""
        at = self.known.get(token)
        if at is None:
            if len(self.known) > MEMO_TOKENS:
                self.known.clear()
            own = own_features(token)
            key = (*own, beside_kind(token))
            at = self.alike.get(key)
            if at is None:
                at = self.alike[key] = len(self.alike)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                total = self.field.total
                self.table[at] = np.stack([total(own), total(beside_features(token, "before:")), total(beside_features(token, "after:")), *[total(hint_features(token, d)) for d in range(2, REACH + 1)]])
            self.known[token] = at
        return at

    def vectors(self, token: str) -> np.ndarray:
        at = self.row(token)
        return self.table[at]

    def may_be_secret(self, token: str, change: int) -> bool:
        return lead(self.vectors(token)[0]) + self.before + self.after + change * STEP <= self.slack

    def is_none_alone(self, token: str, change: int) -> bool:
        """Whether a token that may be a secret is none between two settled ones."""
        own, moves = self.vectors(token)[0], self.field.moves
        rest = self.before + self.after + change * STEP
        return all(own[OUTSIDE] - own[x] + rest > moves[OUTSIDE, x] + moves[x, OUTSIDE] - 2 * moves[OUTSIDE, OUTSIDE] for x in (BEGIN, INSIDE))

    def emissions(self, tokens: list[str], first: int = 0, last: int | None = None, whole: np.ndarray | None = None) -> np.ndarray:
        """What speaks for each tag of the tokens from first to last."""
        last = len(tokens) - 1 if last is None else last
        whole = self.field.total(file_features(tokens)) if whole is None else whole
        at = min(first, REACH)
        rows = list(map(self.row, tokens[first - at : last + 2]))
        held, n = self.table[rows], last - first + 1
        out = held[at : at + n, 0] + whole
        for d in range(1, REACH + 1):  # the token d before
            skip = max(0, d - at)
            if skip < n:
                out[skip:] += held[at + skip - d : at + n - d, 1 if d == 1 else 1 + d]
        after = held[at + 1 : at + 1 + n, 2]
        out[: len(after)] += after
        return out

    def added(self, text: str, tokens: list[str] | None = None, distinct: set[str] | None = None) -> list[tuple[int, int]]:
        """(start, end) of each run of tokens tagged as a secret."""
        if not self.field.weights:
            return []
        tokens = TOKEN.findall(text) if tokens is None else tokens
        if not tokens:
            return []
        distinct = set(tokens) if distinct is None else distinct
        whole = self.field.total(file_features(tokens))
        change = math.floor(lead(whole) / STEP)
        other, n = self.unsettled(distinct, change), len(tokens)
        looked_at = {0, n - 1}  # the first and the last have one neighbour only
        if other:
            places = [i for i, t in enumerate(tokens) if t in other]
            for i in places:
                _, _, next_, previous, hint = other[tokens[i]]
                if next_ or previous or hint:
                    looked_at.update(range(max(0, i - previous), min(n, i + 1 + (REACH if hint else next_))))
            forced = frozenset(looked_at)
            for i in places:
                may, alone, *_ = other[tokens[i]]
                if may and not (alone and i not in forced and i - 1 not in forced and i + 1 not in forced and not other.get(tokens[i - 1], NOTHING)[0] and not other.get(tokens[i + 1], NOTHING)[0]):
                    looked_at.add(i)
        tags, alike, group = {}, {}, []
        for i in [*sorted(looked_at), n + 1]:
            if group and i != group[-1] + 1:
                first, last = group[0], group[-1]
                # equal surroundings have equal tags: texts with much of the like have few different ones
                key = first < REACH, last > n - 2, *map(self.row, tokens[max(0, first - REACH) : last + 2])
                held = alike.get(key)
                if held is None:
                    held = alike[key] = self.tags_of(tokens, first, last, whole)
                tags.update((first + k, tag) for k, tag in held)
                group = []
            group.append(i)
        if not tags:
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        found, start, last = [], None, None
        for i in [*sorted(tags), n + 1]:
            tag = tags.get(i, OUTSIDE)
            if start is not None and (tag != INSIDE or i != last + 1):
                found.append((places[start][0], places[last][1]))
                start = None
            if tag == BEGIN or tag == INSIDE and start is None:
                start = i
            last = i
        return found

    def tags_of(self, tokens: list[str], first: int, last: int, whole: np.ndarray) -> list[tuple[int, int]]:
        """(place after first, tag) of the tokens from first to last that are not outside; what is beside them is."""
        emit, moves, found = self.emissions(tokens, first, last, whole), self.field.moves, []
        open_ = np.nonzero(emit[:, OUTSIDE] - np.maximum(emit[:, BEGIN], emit[:, INSIDE]) <= self.slack)[0]
        if not len(open_):
            return found
        # a stretch of secret gains at most what its tokens do, each with the best move inside, and the best moves into it and out
        # of it; where no token gains by a move inside, the best stretch is one token
        gain = np.maximum(emit[open_, BEGIN], emit[open_, INSIDE]) - emit[open_, OUTSIDE]
        inside = moves[:2, :2].max() - moves[OUTSIDE, OUTSIDE]
        around = moves[OUTSIDE, :2].max() + moves[:2, OUTSIDE].max() - 2 * moves[OUTSIDE, OUTSIDE]
        may = (gain + inside > 0) | (gain + around >= 0)
        if not may.any():
            return found
        runs = np.cumsum(np.diff(open_, prepend=open_[0]) > 1)
        for run in np.unique(runs[may]).tolist():
            part = open_[runs == run]
            found += [(int(k), tag) for k, tag in zip(part, viterbi(emit[part], moves), strict=True) if tag != OUTSIDE]
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
        """(spans of the patterns, all spans), each by start and kind."""
        if not text:
            return [], []
        tokens = TOKEN.findall(text)
        distinct = set(tokens)
        base, more, reach = base_spans(text, distinct), [], 0
        starts = [x[0] for x in base]
        ends = [reach := max(reach, x[2]) for x in base]  # the furthest end so far
        for start, end in self.added(text, tokens, distinct):
            before = bisect.bisect_left(starts, end)
            if not before or ends[before - 1] <= start:
                more.append((start, "crf", end))
        return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))


# Alphabets of planted values, how names and values are written together, and forms of look-alikes.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
JOINS = (" = ", "=", ": ", ":", " is ", " ", ' = "', "='", ': "', " -> ", " := ")
NAMED = ("{h}", "{h}", "{H}", "{w}_{h}", "{h}_{w}", "{w}-{h}", "the {w} {h}", "{w} {h}", "{H}_{W}", "Authorization: Bearer")
ALIKE = (
    "{d}{d}{d}{d}-{d}{d}-{d}{d}", "{d}{d}:{d}{d}:{d}{d}", "v{d}.{d}{d}.{d}", "{d}{d}{d}.{d}{d}.{d}.{d}", "+{d}{d} {d}{d}{d} {d}{d}{d}{d}{d}", "({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}", "{d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}",
    "{w}.{w}{d}{d}@{w}.com", "{w}@{w}.org", "https://www.{w}.com/{w}/{w}-{w}?{w}={d}{d}", "/{w}/{w}/{w}_{d}{d}.{w}", "{W}-{d}{d}{d}{d}-{d}{d}{d}{d}{d}", "{W}{d}{d}{d}", "{w}{C}{C}", "{C}{C}{C}{C}", "{w}_{w}_{w}", "{W}_{W}_{W}", "{w}-{w}-{w}", "{w}{w}{w}", "{W}{W}", "{w}{d}", "{d}{w}", "{x}{x}{x}{x}{x}{x}{x}",
    "{x}{x}{x}{x}{x}{x}{x}{x}-{x}{x}{x}{x}-{x}{x}{x}{x}-{x}{x}{x}{x}-{x}{x}{x}{x}{x}{x}{x}{x}{x}{x}{x}{x}", "{W}{W}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}", "#{x}{x}{x}{x}{x}{x}", "{d}{d}.{d}{d}{d},{d}{d}", "{h} {w}", "{h} {w} {w}", "{h}: {w}", "{h} = {w}", "{h} is {w}", "{w} {h}, {w}", "{h}: {d}", "{h} {d}{d}", "{h}s", "{h}.{w}()", "{w}.{h}",
)


def planted_value(draw: random.Random, word: str, named: bool) -> str:
    """A made-up secret. One that could be a word with a number is only made behind a name."""
    some = lambda alphabet, lo, hi: "".join(draw.choice(alphabet) for _ in range(draw.randint(lo, hi)))
    mixed = LOWER + UPPER + DIGITS
    kind = draw.randrange(10 if named else 7)
    if kind == 0:
        return some(DIGITS + "abcdef", 16, 64) if draw.random() < 0.5 else some(DIGITS + "ABCDEF", 16, 40)
    if kind in (1, 2):
        return some(mixed, 14, 40)
    if kind == 3:
        return some(mixed + "+/", 20, 64) + draw.choice(("", "=", "=="))
    if kind == 4:
        return some(UPPER, 2, 5) + some(UPPER + DIGITS, 14, 24)
    if kind == 5:
        return some(LOWER, 2, 4) + draw.choice(("_", "-", "_live_", "_test_")) + some(mixed, 16, 36)
    if kind == 6:
        return ".".join(some(mixed + "_-", 12, 40) for _ in range(3)) if draw.random() < 0.5 else some(LOWER + DIGITS, 20, 40)
    if kind == 7:
        return word + some(DIGITS, 1, 4) + draw.choice(("", "!", word, "#" + word, "$"))
    if kind == 8:
        return word.title() + some(DIGITS, 2, 4) + draw.choice("!?#$*")
    return some(mixed + "!#$%*", 8, 14)


def planted(draw: random.Random, words: list[str], secret: bool) -> tuple[str, int, int]:
    """(phrase, where the secret in it starts and ends), start and end 0 for a look-alike."""
    word = lambda: draw.choice(words)
    hint = draw.choice(sorted(HINTS))
    if not secret:
        form = draw.choice(ALIKE)
        for mark, make in (("{w}", lambda: word().lower()), ("{W}", lambda: word().upper()), ("{C}", lambda: word().title()), ("{h}", lambda: hint), ("{d}", lambda: draw.choice(DIGITS)), ("{x}", lambda: draw.choice(DIGITS + "abcdef"))):
            while mark in form:
                form = form.replace(mark, make(), 1)
        return form, 0, 0
    named = draw.random() < 0.65
    value = planted_value(draw, word().lower(), named)
    if not named:
        return value, 0, len(value)
    name = draw.choice(NAMED).format(h=hint, H=hint.upper(), w=word().lower(), W=word().upper())
    join = " " if name.endswith("Bearer") else draw.choice(JOINS)
    return name + join + value + join[-1] * (join[-1] in "'\""), len(name + join), len(name + join + value)


def tagged(places: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """The tag of each token, of those that lie in a secret."""
    tags, starts = [OUTSIDE] * len(places), [a for a, _ in places]
    for start, end in secrets:
        i, inside = bisect.bisect_left(starts, start), False
        while i < len(places) and places[i][1] <= end:
            tags[i] = INSIDE if inside else BEGIN
            i, inside = i + 1, True
    return tags


def windows(texts: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """(features of each token, tags) of windows around matches and around what is planted, and of windows of the text as it is."""
    found = []
    for text in texts:
        draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")))  # a text is planted with the same things everywhere
        places = [m.span() for m in TOKEN.finditer(text)]
        if not places:
            continue
        tokens = [text[a:b] for a, b in places]
        secrets = [ASSIGN.match(text, start).span(2) if kind == "assign" else (start, end) for start, kind, end in base_spans(text)]
        tags, whole = tagged(places, secrets), file_features(tokens)

        def take(tokens, tags, whole, lo, hi):
            lo, hi = max(0, lo), min(len(tokens), hi)
            while lo and tags[lo] == INSIDE:  # a window ends where a secret does
                lo -= 1
            while hi < len(tokens) and tags[hi] == INSIDE:
                hi += 1
            found.append(([features_at(tokens, i, whole) for i in range(lo, hi)], tags[lo:hi]))

        begins = [i for i, t in enumerate(tags) if t == BEGIN]
        for i in begins[:WINDOWS_OF_TEXT]:
            take(tokens, tags, whole, i - WINDOW, i + WINDOW)
        at = draw.randrange(len(tokens))
        take(tokens, tags, whole, at - WINDOW, at + WINDOW)
        words = [t for t in tokens[:: max(1, len(tokens) // 64)] if t.isalpha()] or ["word"]
        for k in range(2 * PLANTED):
            phrase, start, end = planted(draw, words, k % 2 == 0)
            own = [m.span() for m in TOKEN.finditer(phrase)]
            at = draw.randrange(len(tokens) + 1)
            while at < len(tags) and tags[at] == INSIDE:
                at += 1
            grown = tokens[:at][-2 * WINDOW :] + [phrase[a:b] for a, b in own] + tokens[at:][: 2 * WINDOW]
            marks = tags[:at][-2 * WINDOW :] + tagged(own, [(start, end)] if end else []) + tags[at:][: 2 * WINDOW]
            first = min(at, 2 * WINDOW)
            take(grown, marks, whole, first - WINDOW, first + len(own) + WINDOW)
    return found


def fit(given: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, shrink: float = 3e-4, rate: float = 0.3) -> SecretField:
    """Conditional maximum likelihood by forward-backward and adaptive gradient steps over all windows at once.

    Before a window and after it stands outside, as in decoding.
    """
    if not given:
        return SecretField({}, np.zeros((3, 3)))
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in given for row in rows for f in row}))}
    data = _Windows(given, names)
    weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(rounds):
        _, grad, grad_m = data.gradient(weights, moves)
        grad, grad_m = grad / data.n - shrink * weights, grad_m / data.n - shrink * moves
        seen_w += grad**2
        seen_m += grad_m**2
        weights += rate * grad / np.sqrt(seen_w)
        moves += rate * grad_m / np.sqrt(seen_m)
    return SecretField({f: tuple(weights[i].tolist()) for f, i in names.items()}, moves)


class _Windows:
    """Windows as arrays: the feature numbers of all tokens one after another, and the tokens' places."""

    def __init__(self, given, names: dict[str, int]):
        self.n, self.length = len(given), max(len(tags) for _, tags in given)
        self.real, self.gold = np.zeros((self.n, self.length), bool), np.full((self.n, self.length), OUTSIDE)
        for w, (_, tags) in enumerate(given):
            self.real[w, : len(tags)] = True
            self.gold[w, : len(tags)] = tags
        rows = [[names[f] for f in row] for own, _ in given for row in own]
        sizes = np.array([len(r) for r in rows])
        self.flat, self.starts = np.array([f for r in rows for f in r], np.int64), np.concatenate([[0], sizes.cumsum()[:-1]])
        self.token, self.width = np.repeat(np.arange(len(rows)), sizes), len(names)
        self.last = self.real.sum(axis=1) - 1

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood, its gradient by the weights, by the moves)"""
        n, length, real, gold = self.n, self.length, self.real, self.gold
        emit = np.zeros((n, length, 3))
        emit[real] = np.add.reduceat(weights[self.flat], self.starts)
        fore, back = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        fore[0] = emit[:, 0] + moves[OUTSIDE]
        for t in range(1, length):
            step = fore[t - 1][:, :, None] + moves
            fore[t] = np.where(real[:, t, None], emit[:, t] + _log_sum(step, 1), fore[t - 1])
        back[length - 1] = moves[:, OUTSIDE]
        for t in range(length - 2, -1, -1):
            step = moves + (emit[:, t + 1] + back[t + 1])[:, None, :]
            back[t] = np.where(real[:, t + 1, None], _log_sum(step, 2), moves[:, OUTSIDE])
        norm = _log_sum(fore[0] + back[0], 1)
        p = np.exp(fore + back - norm[None, :, None]).transpose(1, 0, 2) * real[..., None]
        grad_m, rows = np.zeros((3, 3)), np.arange(n)
        value = float(emit[rows[:, None], np.arange(length), gold][real].sum() - norm.sum())
        # into the first token and out of the last
        np.add.at(grad_m, (np.full(n, OUTSIDE), gold[:, 0]), 1)
        np.add.at(grad_m, (gold[rows, self.last], np.full(n, OUTSIDE)), 1)
        pair = real[:, 1:]
        np.add.at(grad_m, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
        value += float((grad_m * moves).sum())
        grad_m[OUTSIDE] -= p[:, 0].sum(axis=0)
        grad_m[:, OUTSIDE] -= p[rows, self.last].sum(axis=0)
        for t in range(1, length):
            on = real[:, t]
            grad_m -= np.exp(fore[t - 1][on][:, :, None] + moves + (emit[:, t] + back[t])[on][:, None, :] - norm[on][:, None, None]).sum(axis=0)
        miss = (np.eye(3)[gold] - p)[real]
        grad = np.stack([np.bincount(self.flat, miss[self.token, k], self.width) for k in range(3)], axis=1)
        return value, grad, grad_m


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> SecretField:
    """A field from the sample_texts whose hashed ids are smallest; only ids are read to choose them."""
    known = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lit(1).alias("_all"))
    ids = [r[0] for r in sample_by_hash(known, "_id", "_all", sample_texts).select("_id").collect()]
    # of an id that several rows have, one text, so what is fetched is bounded by the sample
    rows = docs.filter(F.col(id_col).isin(ids) & F.col(text_col).isNotNull()).groupBy(id_col).agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col))).collect() if ids else []
    return fit(windows([r[1] for r in sorted(rows, key=lambda r: r[0]) if r[1]]))


def scan(docs: DataFrame, field: SecretField, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined)."""

    def line(spans):
        return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)

    def make():
        scanner = Scanner(field)

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            counts = [[sum(kind == k for _, kind, _ in base) for base, _ in found] for k in KINDS[:3]]
            return *counts, [hashlib.sha256(line(base).encode()).hexdigest() for base, _ in found], [line(every) for _, every in found]

        return work

    return append_columns(docs, [text_col], [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")], make, keep)
