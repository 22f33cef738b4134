"""Awkward documents that every operator on texts must take: nulls, empty and very long texts, ties, repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(r, n, vocab=400):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def awkward(seed=1):
    r = random.Random(seed)
    passage = " ".join(words(r, 60))
    base = " ".join(words(r, 120))
    near = [base.replace(w, "zz", 1) for w in base.split()[5:40:7]]
    texts = [
        None, "", " \t\n ", "one", "a b", base, base, *near, passage + "\n" + " ".join(words(r, 40)), " ".join(words(r, 30)) + "\n" + passage + "\n\n",
        " ".join(words(r, 20_000)), "x " * 3000, "A shared Line here\n a SHARED line here \nown line number one", "a shared line here\r\nother", "日本語のテキスト です。" * 3,
        "ÀÉ é 🎉 mixed space and  \n b", "it's  we'll don't\n\n\ttabs", "short key\nshort key", "# * $ % & | < >" * 20, "".join(r.choice("ab \n’é#") for _ in range(300)),
    ]
    rows = [(k * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s2", None]), len(t or ""), "x") for k, t in enumerate(texts)]
    rows += [rows[5], (None, "a document without an id but with a shared line here\na shared line here", "en", "s1", 10, None)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
