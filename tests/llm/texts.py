"""Small tables for the operators of the subpackage: nulls, empty, long, repeated and near-equal texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(rng.choice(("w", "Wo", "é", "漢", "x-")) + str(rng.randrange(vocabulary)) for _ in range(words))


def documents(spark, seed: int = 7, rows: int = 120):
    """Texts with copies, near copies, shared passages and every odd case."""
    rng = random.Random(seed)
    shared = [sentence(rng, 40, 10_000) for _ in range(3)]
    base = [sentence(rng, 150, 10_000) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "A b c", "x " * 3000, "tie tie tie " * 30]
    for at in range(rows):
        kind = at % 6
        if kind == 0:
            texts.append(sentence(rng, rng.randint(1, 60), 10_000))
        elif kind == 1:
            texts.append(sentence(rng, 20) + "\n" + rng.choice(shared) + "  " + sentence(rng, 15))
        elif kind in (2, 3):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
            texts.append(" ".join(words))
        elif kind == 4:
            texts.append(rng.choice(texts[8:] or ["copy"]))
        else:
            texts.append("\n".join([sentence(rng, 9), "same line here", "same line here", "#*# $ <b> " * 3]))
    data = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rng.shuffle(data)
    data += [(None, texts[12], None, None, None), (None, None, None, None, None), data[5], data[5]]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
