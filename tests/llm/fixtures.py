"""Hard rows that every operator on documents meets."""

DOC = "doc_id long, text string, lang string, source string, n_chars long, _n long, p_ string, k string"
LONG = " ".join(f"wort{i * i % 977}" for i in range(30_000))


def rows():
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    edited = base.replace("alpha30", "gamma30", 1)
    texts = [
        None,
        "",
        " \t\n\x0b ",
        "One",
        base,
        base,
        edited,
        LONG,
        "Über-Größe naïve 中文   x y <|endoftext|> it's we'll",
        "a\n\n" + base + "\nb",
        "1 2 3 !!! ###",
    ]
    out = [(i, t, "en" if i % 3 else None, None if i == 6 else f"s{i % 3}", None if t is None else len(t), i, "x", "y") for i, t in enumerate(texts)]
    return out + [out[4], (None, "no key here at all", "en", "s1", 18, 1, "x", "y"), (None, None, None, None, None, None, None, None)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC)
