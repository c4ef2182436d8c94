"""Texts with every awkward case, and words by the plain rule."""

import random
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, n_words, kept, shard): the last three are columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "tion", "ther", "eau", "für", "niño", "größe", "A.", "x***", "日本", "\u00a0odd", "b|"]
    texts = [None, "", " \n\t ", "one", "one two three four", "A b c d e", "a b c d e", "a\x00b c\x0bd", "same line\nsame line\n\nsame line\nother", "x\n", "\nx", "x\ny\nx"]
    base = [rng.choice(vocabulary) + str(rng.randint(0, 400)) for _ in range(160)]
    texts += [" ".join(base), " ".join(base), " ".join(base[:-1]), " ".join(base[5:]) + "\nend", " ".join(base[:80] + ["NEW"] + base[80:])]
    texts += ["\n".join([" ".join(base[20:75])] * 3), " ".join(["go"] * 300), " ".join(rng.choice(vocabulary) for _ in range(6000))]
    while len(texts) < n:
        t = [rng.choice(vocabulary) + str(rng.randint(0, 3000)) for _ in range(rng.randint(1, 250))]
        if rng.random() < 0.3:
            at = rng.randint(0, len(t))
            t[at:at] = base[30 : 30 + rng.randint(45, 70)]
        texts.append(" ".join(t).replace(" x*** ", "\n"))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], None if i % 7 == 0 else "en", "s", 1, 2, True, 3) for i, k in enumerate(order)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, shard long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def write(spark, tmp_path, rows):
    """A folder with this documents table, for the op queries."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
