"""Small document tables with the awkward rows every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    """Documents numbered from 1; a tuple gives the source or (source, lang) as well."""
    rows = []
    for i, t in enumerate(texts, 1):
        text, src, lng = (t if isinstance(t, tuple) else (t,)) + ((source, lang) if not isinstance(t, tuple) else ())
        rows.append((i, text, lng, src, len(text or "")))
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs, *names):
    """The same rows with extra columns that bear the operators' own names."""
    for n in names:
        docs = docs.selectExpr("*", f"'x' AS `{n}`")
    return docs


def records(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
