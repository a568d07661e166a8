"""Text out of artifacts and back: tables, a methods card, checks of numbers that a document cites, and of a run that was made
again. All on the driver, over a few small files."""

from __future__ import annotations

import json
import re
from pathlib import Path

from weftline.sinks import invalid, resolve, sha256_bytes, sha256_canonical


def _cell(x) -> str:
    return "-" if x is None else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def table(columns: list[str], rows: list[list]) -> str:
    """A Markdown table."""
    lines = [columns, ["-"] * len(columns), *[[_cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n"


RESULTS = ("precision", "recall_labelled", "recall_overall", "f1", "coverage", "unverified_accepts_share")


def results_table(figures: dict) -> str:
    """The figures of every method of a snapshot, with the review queue."""
    return table(["method", *RESULTS, "review queue"], [[m, *[x["metrics"][k]["value"] for k in RESULTS], x["counts"]["review_queue"]["value"]] for m, x in figures["methods"].items()])


def floors_table(figures: dict, method: str, floors: tuple[float, ...] | None = None) -> str:
    points = figures["methods"][method]["review_floor"]["points"]
    return table(["floor", "queue", "share of test records", "recall with review"], [[p["floor"], p["queue_total"], p["queue_share_of_test_a"], p["recall_with_review"]] for p in points if floors is None or p["floor"] in floors])


def methods_card(records: dict[str, dict], figures: dict, definitions: dict[str, str]) -> str:
    """What each method is, how it was fitted, how it does, and what the figures mean."""
    out = ["# Methods\n"]
    for name, r in records.items():
        out.append(f"## {name}\n\n{r.get('description', '')}\n")
        out.append("Thresholds: " + ", ".join(f"{k} {v}" for k, v in sorted(r["thresholds"].items())) + ".\n")
        if r.get("parameters"):
            out.append(table(["parameter", "value"], [[k, v if isinstance(v, int | float | str) else json.dumps(v, sort_keys=True)] for k, v in sorted(r["parameters"].items())]))
        if name in figures["methods"]:
            out.append(table(["figure", "value", "of"], [[k, x["value"], None if x["denominator"] is None else f"{_cell(x['numerator'])} / {_cell(x['denominator'])}"] for k, x in figures["methods"][name]["metrics"].items()]))
    out.append("## Definitions\n\n" + "\n".join(f"- **{k}**: {v}" for k, v in definitions.items()) + "\n")
    return "\n".join(out)


# numbers in documents

NUMBER = re.compile(r"(?<![\w.#/-])(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(\s?%)?(?![\w/]|\.\d)")
CITED = re.compile(r"<!--\s*cite:\s*(.*?)\s*-->", re.DOTALL)
#: Ratios in words.
SHARES = {"half": 1 / 2, "a third": 1 / 3, "one third": 1 / 3, "two thirds": 2 / 3, "a quarter": 1 / 4, "one quarter": 1 / 4, "three quarters": 3 / 4, "a fifth": 1 / 5, "a tenth": 1 / 10}
TIMES = {"twice": 2.0, "double": 2.0, "three times": 3.0, "four times": 4.0, "five times": 5.0, "ten times": 10.0}
WORDED = re.compile(r"\b(?:(up to|at most|under|less than|more than|over|at least|nearly|almost|about|around|roughly)\s+)?(" + "|".join(sorted([*SHARES, *TIMES], key=len, reverse=True)) + r")\b", re.IGNORECASE)


def value_matches(written: str, value) -> bool:
    """Whether a number, written with its commas, decimals and percent sign, is the value to the digits that are written."""
    if value is None or isinstance(value, bool) or not isinstance(value, int | float):
        return False
    plain = written.replace(",", "").replace("%", "").strip()
    scale = 100 if "%" in written and abs(value) <= 1 else 1
    places = len(plain.partition(".")[2])
    return abs(float(plain) - value * scale) <= 0.5 * 10**-places + 1e-9


def worded_matches(qualifier: str | None, phrase: str, value) -> bool:
    """Whether a ratio in words holds: a quarter off for a multiple, a tenth of itself for a share; one-sided where the words are."""
    if value is None or isinstance(value, bool) or not isinstance(value, int | float):
        return False
    said = (SHARES | TIMES)[phrase.lower()]
    slack, q = (0.25 if said > 1 else said / 10), (qualifier or "").lower()
    low, high = said - slack, said + slack
    if q in ("up to", "at most", "under", "less than"):
        low, high = float("-inf"), said
    elif q in ("more than", "over", "at least"):
        low, high = said, float("inf")
    elif q in ("nearly", "almost"):
        high = said
    return low - 1e-9 <= value <= high + 1e-9


def document_problems(text: str, artifacts: dict[str, object]) -> list[str]:
    """The numbers and ratios in a document that its citations do not bear out, by line.

    A line's figures are cited by a comment `<!-- cite: file#key; file#key -->` in it; files are given as loaded objects. A line
    without a comment makes no claim, except that a percentage or a number with a thousands comma is always one.
    """
    found = []
    for at, line in enumerate(text.splitlines(), 1):
        cites = [c.strip() for held in CITED.findall(line) for c in held.split(";") if c.strip()]
        plain, values = CITED.sub("", line), []
        for c in cites:
            file, _, key = c.partition("#")
            try:
                values.append(resolve(artifacts[file], key))
            except (KeyError, IndexError, TypeError):
                found.append(f"{at}: nothing at {c}")
        for m in NUMBER.finditer(plain):
            written = m[0].strip()
            if not cites:
                if "%" in written or "," in written:
                    found.append(f"{at}: {written} without a citation")
            elif values and not any(value_matches(written, v) for v in values):
                found.append(f"{at}: {written} is not among the cited values")
        for m in WORDED.finditer(plain):
            if values and not any(worded_matches(m[1], m[2], v) for v in values):
                found.append(f"{at}: {m[0].strip()} does not hold")
    return found


# a run that was made again


def differences(root: str, again: str, schemas: dict[str, dict] | None = None, volatile: frozenset[str] = frozenset({"runtime", "created_at_utc", "generated_at_utc", "decided_at_utc"})) -> list[str]:
    """What differs between the artifacts of two runs, and in the first what breaks its schema or its own digest.

    JSON is compared without the volatile keys; other files by their bytes.
    """

    def steady(x):
        return {k: steady(v) for k, v in x.items() if k not in volatile} if isinstance(x, dict) else [steady(v) for v in x] if isinstance(x, list) else x

    files = [{p.relative_to(r).as_posix(): p for p in Path(r).rglob("*") if p.is_file() and not any(part.startswith((".", "_")) for part in p.relative_to(r).parts)} for r in (root, again)]
    found = [f"{n}: only in the first" for n in sorted(set(files[0]) - set(files[1])) if n.endswith(".json")] + [f"{n}: only in the second" for n in sorted(set(files[1]) - set(files[0])) if n.endswith(".json")]
    for name in sorted(set(files[0]) & set(files[1])):
        first, second = files[0][name].read_bytes(), files[1][name].read_bytes()
        if not name.endswith(".json"):
            found += [f"{name}: other bytes"] * (sha256_bytes(first) != sha256_bytes(second) and not name.endswith((".parquet", ".crc")))
            continue
        held = json.loads(first)
        if steady(held) != steady(json.loads(second)):
            found.append(f"{name}: other content")
        if schemas and name in schemas:
            found += [f"{name} {p}" for p in invalid(held, schemas[name])]
        if isinstance(held, dict) and "sha256" in held and "digested" in held and sha256_canonical({k: held[k] for k in held["digested"]}) != held["sha256"]:
            found.append(f"{name}: its digest is not that of its content")
    return found
