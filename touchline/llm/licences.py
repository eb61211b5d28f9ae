"""Licence scans by a positional index of rare words. Column expressions only.

Templates are short fixed notices with the phrases that must stand in them. The index of a template holds the places of its
rarest words, chosen by their document frequency in the corpus, that is by the highest inverse document frequency. In a text,
each occurrence of an indexed word proposes where the template would begin: its place less the word's place in the template.
Places proposed by several of a template's words (the intersection of their postings by relative position) are candidates;
a candidate counts if each mandatory key phrase stands near its place in the template. Of the base phrases all words are
indexed and must agree, so each of their places is found.

Words are runs of digits, letters and everything outside ASCII, lower-cased. The index comes to the driver: at most the words
of the templates, whatever the corpus. Each text is judged in its own row, so nothing is shuffled but the counts of the
templates' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Label, words of a notice, phrases of it that must be there.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parameters: indexed words of a notice, how many of them must agree, and how far a key phrase may be from its place.
RARE, AGREE, SLACK = 4, 2, 6


def words_of(text: Column) -> Column:
    """The words of a text. The Kelvin sign, which alone beside A-Z has an ASCII lower case, is replaced by another letter."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once however often they are used: a generator of one row keeps them from being inlined."""
    row = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", row.alias("_row")).select(*df.columns, "_row.*")


def document_counts(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of (words) each of ``vocabulary`` stands."""
    met = rows.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("w"))
    return {r["w"]: r["n"] for r in met.groupBy("w").agg(F.count("*").alias("n")).collect()}


def index(rows: DataFrame, notices=NOTICES, rare: int = RARE, agree: int = AGREE) -> list[dict]:
    """The templates with their postings: of each notice the ``rare`` words of the lowest document counts in ``rows``, ties by place."""
    split = [(label, notice.split(), [k.split() for k in keys]) for label, notice, keys in notices]
    counts = document_counts(rows, sorted({w for _, words, _ in split for w in words}))
    made = [{"label": label, "base": True, "words": phrase.split(), "postings": list(enumerate(phrase.split())), "agree": len(phrase.split()), "keys": []} for label, phrase in BASE]
    for label, words, keys in split:
        chosen = sorted(enumerate(words), key=lambda x: (counts.get(x[1], 0), x[0]))[:rare]
        places = [(next(i for i in range(len(words)) if words[i : i + len(k)] == k), k) for k in keys]
        made.append({"label": label, "base": False, "words": words, "postings": chosen, "agree": min(agree, len(chosen)), "keys": places})
    return made


def _lit(value) -> Column:
    """Nested lists, dicts and plain values as one constant."""
    if isinstance(value, list):
        return F.array(*map(_lit, value))
    if isinstance(value, dict):
        return F.struct(*[_lit(v).alias(k) for k, v in value.items()])
    return F.lit(value)


def scan(docs: DataFrame, notices=NOTICES, rare: int = RARE, agree: int = AGREE, slack: int = SLACK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    A null or empty text has no words, no labels and score 0. The score is the largest share of a found notice's words that
    stand at their places, 1 for a base phrase. ``found`` lists (label, at) of all places of base phrases and notices. Rows
    that repeat an id, or have none, are judged by their own text; other columns are ignored; an empty table gives no row.
    """
    rows = _held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words=words_of(F.col("text"))).drop("text")
    templates = index(rows, notices, rare, agree)
    indexed = sorted({w for t in templates for _, w in t["postings"]})
    postings = _lit([[{"t": k, "at": at} for k, t in enumerate(templates) for at, v in t["postings"] if v == w] for w in indexed])
    facts = _lit([{"label": t["label"], "base": t["base"], "agree": t["agree"], "words": t["words"], "keys": [{"at": at, "words": key} for at, key in t["keys"]] or [{"at": 0, "words": t["words"]}]} for t in templates])
    n, of = F.size("words"), lambda x: F.get(facts, x["t"])
    word = lambda i: F.get("words", i)

    hits = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: word(i).isin(indexed))).otherwise(F.expr("cast(array() as array<int>)"))
    d = _held(rows, hits=hits)
    number = F.create_map(*[x for i, w in enumerate(indexed) for x in (F.lit(w), F.lit(i))])
    proposed = F.transform("hits", lambda i: F.transform(F.get(postings, F.element_at(number, word(i))), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("start"))))
    d = _held(d, proposed=F.array_sort(F.flatten(proposed)))
    # equal proposals stand together, one from each posting that agrees: the first of as many as are needed stays
    agreed = F.filter("proposed", lambda x, i: ((i == 0) | (F.get("proposed", F.greatest(i - 1, F.lit(0))) != x)) & (F.get("proposed", i + of(x)["agree"] - 1) == x))
    d = _held(d.drop("hits"), agreed=agreed)

    def stands(x: Column, key: Column) -> Column:
        near = F.sequence(x["start"] + key["at"] - slack, x["start"] + key["at"] + slack)
        return F.exists(near, lambda i: (i >= 0) & (F.slice("words", F.greatest(i, F.lit(0)) + 1, F.size(key["words"])) == key["words"]))

    verified = F.filter("agreed", lambda x: of(x)["base"] | F.forall(of(x)["keys"], lambda key: stands(x, key)))
    share = lambda x: F.size(F.filter(of(x)["words"], lambda w, j: F.when(x["start"] + j >= 0, word(x["start"] + j) == w).otherwise(False))) / F.size(of(x)["words"])
    d = _held(d.drop("proposed"), found=F.transform(verified, lambda x: F.struct(of(x)["label"].alias("label"), x["start"].cast("long").alias("at"), of(x)["base"].alias("base"), share(x).alias("share"))))
    d = _held(d.withColumn("n", n).drop("words", "agreed"), places=F.transform(F.filter("found", lambda x: x["base"]), lambda x: x["at"]))
    listed = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        listed(F.filter("found", lambda x: x["base"])).alias("base_labels"), listed(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["at"].alias("at"))).alias("found"),
    )
