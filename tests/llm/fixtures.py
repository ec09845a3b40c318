"""Hand-made documents with nulls, empty and very long texts, copies and repeated rows."""

import random


def documents(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "of", "naïve", "Éa", "the,"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, "\n".join(say(r.randint(1, 25)) for _ in range(r.randint(1, 6)))) for i in range(60)]
    base = say(120).split()
    for i in range(40):  # near copies
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 30)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, rows[5][1]) for i in range(12)]  # copies
    rows += [(220 + i, "Shared Line \n" + say(30) + "\n\tshared line") for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, "no id here at all"), (None, None), (303, "x" * 70_000)]
    rows += [(304, "a b " * 30_000), (305, "one"), (306, "ONE"), (307, "two words"), (307, "two words")]
    rows += [(308, "\x1c\x85\xa0 a　b"), (309, "漢字 🙂🙂 it's I'LL <|endoftext|>x"), rows[7], rows[7]]
    return rows


CLASHING = "digest sig n key hash id number size shard line lines range score uid node query rank own0 view_text keep0 starts".split()


def frame(spark, rows, text="text", clash=True):
    """(doc_id, text) with many more columns under names that operators use."""
    df = spark.createDataFrame(rows, f"doc_id long, {text} string").repartition(5)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("z").alias(c) for c in CLASHING if c not in df.columns])
    return df
