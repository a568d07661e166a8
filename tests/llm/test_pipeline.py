"""The pipeline against stage-by-stage brute force on a small table, and its contract."""

import random

import corpus_pipeline
from weftline.llm import pii

EN, DE = ["the", "ing", "and", "er", "th", "on"], ["der", "ung", "sch", "ein", "ß", "ü"]


def words(seed, n, syllables):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_each_stage_does_its_work(spark, tmp_path):
    texts = [f"{words(i, 120, EN if i % 2 else DE)}\nWritten under the same licence\nask {'abcdef'[i % 6]}{i}@mail.example.com" for i in range(50)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(60, None, None, "s", None), (61, "123 !!", "en", "s", 6), (62, words(1, 120, EN), "en", "s", 0), (None, words(77, 90, EN), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    language = {r["doc_id"] for r in seen["language_id"]}
    assert language == set(range(50)) | {62, None}
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert [i for i, t in lines.items() if "same licence" in t] == [0] or sum("same licence" in t for t in lines.values()) == 1
    # 62 is the text of 1 without its last line; what is left of 1 then differs by one line
    kept = {r["doc_id"] for r in seen["simhash_near_dedup"]}
    assert kept <= language and {0, 2, 3, None} <= kept
    for r in seen["pii_surrogates"]:
        assert r["n_chars"] == len(r["text"])
        mine = pii.detect(lines[r["doc_id"]])
        assert not any(e.text in r["text"] for e in mine)
    packed = seen["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == kept
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r)[:5] for r in again.collect()), key=repr) == sorted((tuple(r)[:5] for r in packed), key=repr)


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def slow_lines(rows):
    """The second stage on a list of (id, text)."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    where = {}
    for i, t in rows:
        for line in t.split("\n") if i is not None else ():
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(i)
    lost = lambda i, line: i is not None and len(where.get(key(line), ())) > 1 and min(where[key(line)]) != i
    return [(i, "\n".join(x for x in t.split("\n") if not lost(i, x))) for i, t in rows]


def slow_copies(rows):
    """The third stage: one document of each group of fingerprints that three bits at most set apart."""
    import re

    import xxhash

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    known = sorted({(i, t) for i, t in rows if i is not None})
    prints = [fingerprint(t) for _, t in known]
    root = list(range(len(known)))
    changed = True
    while changed:
        changed = False
        for a in range(len(known)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    smallest = {}
    for (i, _), r in zip(known, root, strict=True):
        smallest[r] = min(smallest.get(r, i), i)
    kept = {}
    hashed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    for (i, t), r, p in zip(known, root, prints, strict=True):
        if smallest[r] == i:
            kept[i, p] = min(kept.get((i, p), t), t, key=hashed)  # of one id and fingerprint the text of the smallest hash
    return [(i, t) for (i, _), t in kept.items()] + [(i, t) for i, t in rows if i is None]


def test_every_stage_against_a_slow_form(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    rng, rows = random.Random(5), []
    for i in range(60):
        t = words(i, 150, EN if i % 2 else DE) + f"\nDr. {'Ann Bob Cid'.split()[i % 3]} {'Ames Boyd'.split()[i % 2]} of {i % 7}@mail.example.com"
        rows.append((i, "\n".join(rng.sample(["Shared by very many", "  SHARED by very many ", "short", "also shared here"], 2)) + "\n" + t))
    rows += [(100 + i, rows[i][1] + (" and" if i % 2 else "")) for i in range(10)]  # copies and near copies
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, words(8, 90, DE)), (9, rows[9][1].upper()), (None, words(1000, 80, EN)), (200, words(200, 40_000, EN)), (201, "12 34"), (202, "")]
    frame = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", "s", len(t), "mine") for i, t in rows] + [(203, None, "en", "s", None, "mine")], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen, docs = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
    pairs = lambda name: sorted(((r["doc_id"], r["text"]) for r in seen[name]), key=repr)
    assert pairs("language_id") == sorted(((i, t) for i, t in rows if any(c.isalpha() for c in t)), key=repr)
    assert pairs("line_dedup") == sorted(slow_lines([(r["doc_id"], r["text"]) for r in seen["language_id"]]), key=repr)
    kept = slow_copies([(r["doc_id"], r["text"]) for r in seen["line_dedup"]])
    assert pairs("simhash_near_dedup") == sorted(kept, key=repr) and len(kept) < len(seen["line_dedup"])
    assert len(seen["pii_surrogates"]) == len(kept)
    old, new = {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"]}, {r["doc_id"]: r["text"] for r in seen["pii_surrogates"]}
    stands_for = {}
    for i, t in old.items():
        found, drawn = pii.detect(t), pii.detect(new[i])
        assert [e.kind for e in found] == [e.kind for e in drawn]
        for a, b in zip(found, drawn, strict=True):
            assert stands_for.setdefault((a.kind, a.canonical), b.canonical.partition(":")[2] or b.canonical) == (b.canonical.partition(":")[2] or b.canonical)
    assert len(set(stands_for.values())) == len(stands_for) > 10
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in seen["pii_surrogates"]:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        expected += [(r["doc_id"], p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p : p + 4096]))) for p in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in seen["best_fit_packing"]), key=repr) == sorted(expected, key=repr)
    ends = {}
    for r in sorted(seen["best_fit_packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(e[3] for e in expected) // 4096)
