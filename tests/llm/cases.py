"""Small documents for the corpus operators' tests."""

import random

#: Extra columns are named as results and helpers are, to clash with them.
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, shard int, fp bigint, n_removed bigint, contaminated boolean, start bigint, batch bigint, t int, bin double"
EXTRA = (7, 8, True, 3, 4, 5, False, 1, 2, 0, 0.5)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, *EXTRA)


def prose(rng: random.Random, n: int) -> str:
    stems = ["ra", "ne", "to", "lis", "mon", "ter", "qua", "vel", "ö", "ñu"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


def documents(rng: random.Random, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, repeated rows, nulls in each column, empty, blank and very long texts."""
    rows = [row(i, prose(rng, rng.randint(1, 160)), rng.choice(["en", "de"]), f"s{rng.randint(0, 12)}") for i in range(n)]
    rows += [row(n + i, rng.choice(rows)[1], "en", f"s{i % 13}") for i in range(10)]
    for i in range(10):
        words = (rng.choice(rows)[1] or "").split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append(row(n + 10 + i, " ".join(words), "de", "s1"))
    shared = prose(random.Random(5), 25).replace("\n", "")
    rows += [row(n + 20 + i, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30), "en", f"s{i}") for i in range(13)]
    rows += [row(200, None), row(201, ""), row(202, " \t\n "), row(203, prose(rng, 3000)), row(204, "x" * 5000), (None, "no id " + shared, None, None, *[None] * len(EXTRA)), (205, "no lang " + prose(rng, 40), None, "s1", *EXTRA), (206, "no source " + prose(rng, 40), "en", None, *EXTRA)]
    return rows + rows[:3] + rows[3:4] * 2
