"""A small table of documents with what may go wrong in one, and plain re-statements of the contracts."""

import random

#: Columns that clash with names the operators use.
CLASH = ["fp", "m", "block", "text_bytes", "n_words", "component_id", "sequence_id", "kept", "spans"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def prose(rng: random.Random, n: int, vocab: int = 400) -> str:
    words = []
    for _ in range(n):
        k = int(vocab * rng.random() ** 2)
        w = "".join("aeioutnshrdlé"[(k // 13**j) % 13] for j in range(1 + k % 4)) + "xyzw"[k % 4]
        words.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.1:
            words[-1] += rng.choice(".,")
    out = " ".join(words)
    return out[: len(out) // 2] + "\n" + out[len(out) // 2 :]


def texts(seed: int = 5) -> list:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 20, 90, 300])) for _ in range(40)]
    passage = prose(rng, 60)
    out = [None, "", " \n\t ", "a", "a b", "\xa0 x", "<|endoftext|> A\tB", "zz " * 700, "ééé " * 400, *base]
    out += [base[3], base[3], base[5] + " Tail end.", base[5].replace("e", "o", 1), base[7][:40] + passage + base[8], passage + base[9], base[1][10:] + passage, None, ""]
    return out + [prose(rng, 9000, 3000)]


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    full = [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t) if t else None, *CLASH) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def by_id(df) -> dict:
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out
