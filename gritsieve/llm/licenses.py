"""License scans through a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import query, table

# Separators of words after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN, OTHER = "K", "Å"  # the one sign outside ASCII whose lower case is a letter inside it


@dataclass(frozen=True)
class Template:
    """A licence's wording and the phrases in it that must stand word for word, at their distance."""

    label: str
    wording: str
    key: str
    base: bool = False
    also: tuple[str, ...] = ()

    def mandatory(self) -> list[tuple[int, list[str]]]:
        """(place relative to the key phrase, words) of each mandatory phrase, the key phrase first."""
        wording, found = self.wording.split(), [(0, self.key.split())]
        for phrase in (a.split() for a in self.also):
            found.append((next(i for i in range(len(wording)) if wording[i : i + len(phrase)] == phrase) - self.lead(), phrase))
        return found

    def lead(self) -> int:
        """How many words of the wording stand before the key phrase."""
        wording, key = self.wording.split(), self.key.split()
        return next(i for i in range(len(wording)) if wording[i : i + len(key)] == key)

    def offsets(self) -> dict[str, int]:
        """Each mandatory word's first place relative to the key phrase: its posting."""
        out: dict[str, int] = {}
        for at, phrase in self.mandatory():
            for i, word in enumerate(phrase):
                out.setdefault(word, at + i)
        return out


_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
# The wordings of licence notices, lower-case words only.
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("reserved", "all rights reserved", "all rights reserved"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy",
        also=("to deal in the software without restriction",),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may not use this file except in compliance with the license",
        also=("apache license version 2 0",),
    ),
    Template("gpl-2", _GNU.format("general", 2), "gnu general public license as published by the free software foundation", also=("either version 2 of the license",)),
    Template("gpl-3", _GNU.format("general", 3), "gnu general public license as published by the free software foundation", also=("either version 3 of the license",)),
    Template("agpl-3", _GNU.format("affero general", 3), "gnu affero general public license as published by the free software foundation", also=("either version 3 of the license",)),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "nor the names of its contributors may be used to endorse or promote products derived from this software",
        also=("without specific prior written permission",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        also=("appear in all copies",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _fit(wording: list[str], lead: int):
    """The share of the wording found around a start of its key phrase, ``lead`` words in."""

    def share(start: Column) -> Column:
        same = F.transform(_texts(wording), lambda word, i: F.coalesce(F.get("w", start + i - lead) == word, F.lit(False)))
        return F.size(F.filter(same, lambda x: x)) / len(wording)

    return share


def _stands(template: Template):
    """Do all mandatory phrases stand around a start of the key phrase?"""

    def verified(start: Column) -> Column:
        held = [
            F.when(start + at >= 0, F.slice("w", start + (at + 1), len(phrase)) == _texts(phrase)).otherwise(False)
            for at, phrase in template.mandatory()
        ]
        return reduce(Column.__and__, held)

    return verified


def rarity(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> list[str]:
    """The words of the mandatory phrases, from the one that fewest of all documents hold (ties: by word).

    One pass with map-side combine; what reaches the driver is a count per licence word.
    """
    known = sorted({w for t in templates for w in t.offsets()})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), _texts(known))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in found.collect()}
    return sorted(known, key=lambda w: (df.get(w, 0), w))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, per_template: int = 2
) -> DataFrame:
    """Where licence phrases stand in every text: key, n_words, a column ``places`` (label, starts).

    Each row is scanned by itself, so nothing is shuffled and no group can be hot. A posting of a
    word is its place in a template, relative to the key phrase. In each file, a template's
    ``per_template`` words of the highest IDF are looked up: as a file without one of a template's
    mandatory words cannot hold it, these are the same words in every file that can, and files
    that lack them are left at once. Their occurrences minus their postings are possible starts;
    the starts all of them agree on are verified against all mandatory phrases, word for word and
    at their distance. ``fit`` of a place is the share of the whole wording that stands around it
    at the right relative positions.

    Null and empty texts have no words and no places; repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    ranked = rarity(docs, text, templates)
    rare = [sorted(t.offsets(), key=ranked.index)[:per_template] for t in templates]
    anchors = sorted({w for ws in rare for w in ws})
    rows = docs.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("w"))
    rows = rows.withColumn(
        "found",
        F.when(
            F.arrays_overlap("w", _texts([ws[0] for ws in rare])),
            F.filter(F.transform("w", lambda x, i: F.when(x.isin(anchors), F.struct(x.alias("word"), i.alias("at")))), lambda a: a.isNotNull()),
        ),
    )
    places = []
    for t, words in zip(templates, rare):
        postings = t.offsets()

        def starts_of(word, postings=postings):
            return F.transform(F.filter("found", lambda a: a["word"] == word), lambda a: a["at"] - F.lit(postings[word]))

        starts = starts_of(words[0])
        for word in words[1:]:
            starts = F.array_intersect(starts, starts_of(word))
        found = F.array_sort(F.coalesce(F.filter(starts, _stands(t)), F.array().cast("array<int>")))
        places.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), found.alias("starts"), F.transform(found, _fit(t.wording.split(), t.lead())).alias("fits")))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), F.array(*places)).alias("places"))


def license_report(scan: DataFrame) -> DataFrame:
    """One row per document: counts, first and last place, labels, and the best fit as score."""
    none = F.array().cast("array<int>")
    base = F.flatten(F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["starts"]))

    def labels(chosen: Column) -> Column:
        held = F.filter(chosen, lambda p: F.size(p["starts"]) > 0)
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda p: p["label"]))), ","), F.lit(""))

    scan = scan.withColumn("b", F.coalesce(base, none))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min("b").cast("long").alias("first_word"),
        F.array_max("b").cast("long").alias("last_word"),
        labels(F.filter("places", lambda p: p["base"])).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.flatten(F.transform("places", lambda p: p["fits"]))), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The same places by looking at every word of every text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{SEPARATORS}'), lambda x: x <> '')"

    def literal(phrase: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in phrase.split()) + "]"

    starts, fits = {}, []
    for n, t in enumerate(TEMPLATES):
        lead, wording = t.lead(), t.wording.split()
        held = " AND ".join(f"i + {at} >= 0 AND w[i + {at + 1} : i + {at + len(phrase)}] = {literal(' '.join(phrase))}" for at, phrase in t.mandatory())
        starts[n] = f"list_filter(range(len(w)), lambda i: w[i + 1] = '{t.key.split()[0]}' AND {held}) AS s{n}"
        same = " + ".join(f"CASE WHEN i + {i - lead} >= 0 AND w[i + {i - lead + 1}] = '{word}' THEN 1 ELSE 0 END" for i, word in enumerate(wording))
        fits.append(f"list_transform(s{n}, lambda i: CAST({same} AS DOUBLE) / {len(wording)})")
    base = [n for n, t in enumerate(TEMPLATES) if t.base]

    def labels(chosen) -> str:
        cases = ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{TEMPLATES[n].label}' END" for n in chosen)
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',')"

    return f"""
    WITH t AS (SELECT doc_id, {words} AS w FROM documents),
    p AS (SELECT doc_id, w, {', '.join(starts.values())} FROM t),
    q AS (SELECT *, flatten([{', '.join(f's{n}' for n in base)}]) AS b, flatten([{', '.join(fits)}]) AS f FROM p)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, list_min(b) AS first_word, list_max(b) AS last_word,
      {labels(base)} AS base_labels, {labels(range(len(TEMPLATES)))} AS labels, coalesce(list_max(f), 0.0) AS score FROM q
    """


@query("op10_licenses", _sql())
def op10_licenses(spark, folder):
    """Licence labels and places of all documents."""
    return license_report(scan_licenses(table(spark, folder, "documents")))
