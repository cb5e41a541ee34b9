"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Paragraphs are divided by blank lines. Features are the n-grams around cue words, so the score of a paragraph without
cue words is that of the biases and is not worked out again. Multinomial logistic regression is fitted on the forms in which
licences are named (names of families in sentences, identifiers, dual licences, openings of licence texts), on sentences that use cue words otherwise, and on a bounded
sample of the paragraphs with cue words that the templates label or that name no family. Every fourth form and sentence is
held out whole: on these the temperature of the probabilities is set, and accuracy and calibration error are measured (assess). A prediction
counts as confirmed where the paragraph holds most of the word sequence of one of the family's templates. Scoring is sums of
weights in Spark's own expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

# Notices by which licence families are usually named, and paragraphs that name none.
NOTICES = {
    "apache": ["licensed under the apache license version 2 0", "released under the apache license", "apache software license version 2 0", "apache 2 0 license"],
    "mit": ["released under the mit license", "licensed under the mit license", "this project is mit licensed", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "bsd": ["released under the bsd license", "licensed under the 3 clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "bsd 2 clause license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl", "gnu lesser general public license", "gnu affero general public license version 3", "under the terms of the gnu general public license"],
    "mpl": ["this file is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc sa 4 0"],
    "cc-by": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license", "licensed under cc by sa 4 0"],
    "cc0": ["cc0 1 0 universal public domain dedication", "released into the public domain under cc0", "this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without prior written permission"],
}
# Names of the families as notices and identifiers give them, and the sentences that they stand in.
NAMES = {
    "apache": ["apache license version 2 0", "apache 2 0", "apache license 2 0", "apache 2 0 license"],
    "mit": ["mit license", "mit", "mit licence", "expat mit license"],
    "bsd": ["bsd 3 clause license", "bsd 3 clause", "bsd 2 clause license", "bsd license", "new bsd license"],
    "gpl": ["gnu general public license v3", "gpl 3 0 or later", "gpl 3", "gnu gpl version 2", "lgpl 2 1", "gnu affero general public license", "agpl 3"],
    "mpl": ["mozilla public license 2 0", "mpl 2 0", "mozilla public license v 2 0"],
    "cc-by-nc": ["cc by nc 4 0", "cc by nc sa 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["cc by 4 0", "cc by sa 4 0", "creative commons attribution 4 0 international license"],
    "cc0": ["cc0 1 0", "cc0", "cc0 1 0 universal public domain dedication", "unlicense"],
    "isc": ["isc license", "isc", "isc licence"],
}
FORMS = [
    "licensed under the {}", "released under the {}", "spdx license identifier {}", "this file is licensed under the terms of the {}", "distributed under the {}", "see the file license for the {} text", "{}", "this project is available under the {}",
    "you may use this work under the {}", "license {}", "copyright 2020 the authors {}", "the code is {} licensed", "this software is provided under the {} without warranty", "published under {}", "subject to the terms of the {}", "made available by the authors under the {}",
]
DUAL = ["dual licensed under {} or {}", "licensed under either of {} or {} at your option", "spdx license identifier {} or {}", "available under both {} and {}", "you may choose {} or {}", "dual license {} and {}", "{} or {}", "licensed under {} or at your option {}", "released under both {} and {}", "either {} or at your option the {}", "the terms of both {} and {} apply"]
PROPRIETARY = ["all rights reserved", "copyright all rights reserved", "copyright 2021 the company all rights reserved worldwide", "no part of this publication may be reproduced without prior written permission", "proprietary and confidential", "unauthorized copying of this file is strictly prohibited",
    "this software is proprietary all rights reserved", "may not be reproduced or distributed without permission of the copyright holder", "copyright reserved no copying without written permission", "licensed to the customer only under a commercial license agreement", "reproduction without permission is prohibited", "all rights are reserved by the copyright owner"]
OPENINGS = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose is hereby granted"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"],
    "apache": ["you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0", "apache license version 2 0 january 2004 terms and conditions for use reproduction and distribution"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"],
    "cc0": ["this is free and unencumbered software released into the public domain", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"],
}
OTHERS = ["she passed her driving license exam", "the license plate was lost", "a fishing license is needed here", "permission to land was given", "the public domain of the town", "mit students met there", "copyright law is old", "the version 2 0 came out", "poetic license", "they asked permission from the general", "apache helicopters flew by",
    "under the terms of the treaty", "creative work is common", "with warranty and without", "gnu herds cross the river", "the court granted permission all rights of way remain", "human rights were discussed", "his rights as a citizen", "the warranty lasts two years", "copyright cases in court", "a study at mit found that", "the apache people lived in the south", "cc your manager on the mail",
    "the domain of the function", "the domain name has expired", "she was licensed as a pilot", "the bar lost its license to sell drinks", "redistribution of wealth", "rights and duties", "equal rights for all", "without permission she left", "permission was denied by the court", "mozilla released a new browser", "the license fee for television went up", "a marriage license", "the doctor is licensed in two states",
    "copyright", "license", "permission", "rights", "a gpl student", "the isc met in june", "creative commons were grazed by sheep", "no license no fish", "the licence of the pub", "all rights of the child", "the right to copy", "the permission slip was signed", "a warranty claim was denied", "he has the rights to the song"]
CUES = ("license", "licensed", "licence", "licenced", "licenses", "copyright", "permission", "permitted", "rights", "warranty", "gnu", "gpl", "lgpl", "agpl", "apache", "mit", "bsd", "isc", "mozilla", "mpl", "creative", "cc", "cc0", "domain", "redistribution", "redistributions", "redistribute", "proprietary", "copying", "reproduced", "reproduction", "unlicense", "endorse", "noncommercial", "attribution", "either", "both", "option")
CLASSES = ("unknown", *NOTICES, "isc", "dual")
CUE = " (?:" + "|".join(CUES) + ") "
UNKNOWN, GRAMS, LEAST, MATCH = "unknown", 3, 0.5, 0.7
SAMPLE, GRAMS_EACH = 300, 200  # paragraphs of each label that the model is fitted on, at most, and n-grams of each
HELD = 4  # every so many-th form is held out
BREAK = "\\n[ \\t\\r]*\\n[\\s]*"


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits, one space between and at both ends; gplv3 and the like are two words."""
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(words, "\\b([al]?gpl)v?([0-9])", "$1 $2")), F.lit(" "))


def grams(words: Column) -> Column:
    """The distinct n-grams of one to GRAMS words that hold a cue word. The words are divided once: a lambda would do it again for every cue."""

    def within(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*CUES), i)), lambda i: i.isNotNull())

        def around(i: Column) -> Column:
            spans = [(i - back, n) for n in range(1, GRAMS + 1) for back in range(n)]
            return F.filter(F.array(*[F.when((a >= 0) & (a + n <= F.size(w)), F.array_join(F.slice(w, F.greatest(a, F.lit(0)) + 1, F.lit(n)), " ")) for a, n in spans]), lambda x: x.isNotNull())

        return F.array_distinct(F.flatten(F.transform(at, around)))

    return F.get(F.transform(F.array(F.split(F.trim(words), " ")), within), F.lit(0))


def plain_grams(text: str) -> set[str]:
    words = text.split()
    found = {tuple(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}
    return {" ".join(g) for g in found if set(g) & set(CUES)}


def template_label(words: Column) -> Column:
    """The family of the longest template that the paragraph holds word for word, else unknown."""
    found = F.lit(UNKNOWN)
    for _, text, name in sorted((len(t), t, n) for n, ts in NOTICES.items() for t in ts):
        found = F.when(F.contains(words, F.lit(f" {text} ")), name).otherwise(found)
    return found


def examples() -> tuple[list[tuple[set[str], str]], list[tuple[set[str], str]]]:
    """(to fit on, held out): n-grams and class of each family in each form, of dual licences, openings and other sentences. A
    form or sentence is held out for all families or none."""
    rows: tuple[list, list] = ([], [])

    def add(i: int, text: str, family: str):
        rows[i % HELD == HELD - 1].append((plain_grams(text), family))

    for i, form in enumerate(FORMS):
        for family, names in NAMES.items():
            for name in names:
                add(i, form.format(name), family)
    families = list(NAMES)
    for i, form in enumerate(DUAL):
        for j, one in enumerate(families):
            for k, other in enumerate(families):
                if one != other:
                    add(i, form.format(NAMES[one][(i + k) % len(NAMES[one])], NAMES[other][(i + j) % len(NAMES[other])]), "dual")
    for i, text in enumerate(PROPRIETARY):
        add(i, text, "proprietary")
    for i, text in enumerate(OTHERS):
        add(i, text, UNKNOWN)
    rows[0].extend((plain_grams(t), f) for f, ts in (*OPENINGS.items(), *NOTICES.items()) for t in ts)
    rows[0].append((set(), UNKNOWN))
    return rows


def matrix(some: list[tuple[set[str], str]], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(some), len(at) + 1), np.float32)
    x[:, -1] = 1
    for i, (g, _) in enumerate(some):
        x[i, [at[y] for y in g if y in at]] = 1
    return x, np.array([CLASSES.index(y) for _, y in some], int)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[set[str], str]], held: list[tuple[set[str], str]]) -> dict:
    """Weights by n-gram and class, biases, and the temperature of least loss on the rows held out. The rows are at most the
    forms and SAMPLE paragraphs of each class, so their matrix is bounded."""
    often: dict[str, int] = {}
    for g, _ in rows:
        for x in g:
            often[x] = often.get(x, 0) + 1
    told = {x for ts in (*NOTICES.values(), *OPENINGS.values()) for t in ts for x in plain_grams(t)}
    at = {g: i for i, g in enumerate(sorted(x for x, n in often.items() if n > 1 or x in told))}
    x, y = matrix(rows, at)
    weight = 1 / np.sqrt(np.bincount(y, minlength=len(CLASSES))[y])  # rare classes count for more
    weight = (weight / weight.sum()).astype(np.float32)
    w, goal, step = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.eye(len(CLASSES), dtype=np.float32)[y], np.zeros((x.shape[1], len(CLASSES)), np.float32)
    for _ in range(300):  # with momentum
        step = 0.9 * step - 0.8 * (x.T @ ((softmax(x @ w) - goal) * weight[:, None]) + 0.0001 * w)
        w += step
    z, t = (lambda m: (m[0] @ w, m[1]))(matrix(held, at))
    loss = {s: -np.log(softmax(z * s)[np.arange(len(t)), t] + 1e-12).mean() for s in (0.3, 0.5, 0.7, 1.0, 1.3, 1.6, 2.0, 2.5, 3.0, 4.0, 6.0)}
    scale = min(loss, key=loss.get)
    w = np.round(w * scale, 4)
    return {"classes": list(CLASSES), "weights": {g: w[i].tolist() for g, i in at.items() if np.abs(w[i]).max() > 0.02}, "bias": w[-1].tolist(), "scale": scale}


def assess(model: dict, rows: list[tuple[set[str], str]]) -> dict:
    """Accuracy, calibration error (mean gap of probability and accuracy over tenths) and the rows that are taken wrongly."""
    names = list(model["weights"])
    w = np.array([*(model["weights"][g] for g in names), model["bias"]])
    x, y = matrix(rows, {g: i for i, g in enumerate(names)})
    p = softmax(x @ w)
    best, sure = p.argmax(1), p.max(1)
    best = np.where(sure >= LEAST, best, 0)
    right, tenth = best == y, np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs(sure[tenth == i].mean() - right[tenth == i].mean()) * (tenth == i).mean() for i in range(10) if (tenth == i).any())
    return {"accuracy": float(right.mean()), "calibration_error": float(gap), "wrong": [(sorted(rows[i][0], key=len)[-1:], rows[i][1], CLASSES[best[i]]) for i in np.flatnonzero(~right)]}


def model_of(paragraphs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on the forms and at most sample different paragraphs (words) of each label, the first by hash; paragraphs are labelled by
    the templates that they hold word for word, and unknown where they name no family at all. Longer ones than GRAMS_EACH n-grams are no examples."""
    label = template_label(F.col("words"))
    some = paragraphs.filter(F.rlike("words", F.lit(CUE))).select("words", grams(F.col("words")).alias("g"), label.alias("label")).filter(F.size("g") <= GRAMS_EACH)
    # what names a family without holding a template is no example of the unknown class
    named = " (?:" + "|".join(sorted({n for ns in NAMES.values() for n in ns} | {"all rights reserved", "proprietary", "gnu", "gpl", "creative commons", "isc"})) + ") "
    some = some.filter((F.col("label") != UNKNOWN) | ~F.rlike("words", F.lit(named)))
    parts = sorted({g for ts in (*NOTICES.values(), *OPENINGS.values()) for t in ts for g in plain_grams(t) if g.count(" ") == GRAMS - 1})
    some = some.filter((F.col("label") != UNKNOWN) | ~F.arrays_overlap("g", F.lit(parts)))
    some = written(some.groupBy("g", "label").agg(F.lit(1).alias("one")).select("g", "label", F.xxhash64("g", "label").alias("h")))
    got = []
    for c in (UNKNOWN, *NOTICES):
        got += [(set(r.g), r.label) for r in some.filter(F.col("label") == c).orderBy("h").limit(sample).collect()]  # at most sample rows of each class
    own, held = examples()
    return fit(own + got, held)


def scored(features: Column, model: dict) -> Column:
    """(family, probability) of n-grams that the model knows: biases and weights added up for each class."""
    classes = model["classes"]
    known = F.create_map(*[x for g, w in model["weights"].items() for x in (F.lit(g), F.lit([float(v) for v in w]))]) if model["weights"] else None
    bias = F.lit([float(v) for v in model["bias"]])
    mine = F.filter(features, lambda g: g.isin(sorted(model["weights"]) or [""]))  # one set for all rows
    sums = F.aggregate(mine, bias, lambda a, g: F.zip_with(a, F.element_at(known, g), lambda x, y: x + y)) if known is not None else bias
    names = F.lit(classes)

    def best(s: Column) -> Column:
        top = F.array_max(s)
        return F.struct(F.element_at(names, F.array_position(s, top).cast("int")).alias("family"), (1 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("p"))

    return F.get(F.transform(F.array(sums), best), F.lit(0))


def confirmed(family: Column, words: Column) -> Column:
    """Whether the paragraph holds most of the word triples of a template of the family, or all of a shorter one. Of families without
    templates the openings are the templates; dual licences are not confirmed."""
    found = F.lit(False)
    for name, notices in (NOTICES | {"isc": OPENINGS["isc"]}).items():
        either = F.lit(False)
        for t in notices:
            w = t.split()
            triples = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
            held = sum((F.contains(words, F.lit(f" {x} ")).cast("int") for x in triples[1:]), F.contains(words, F.lit(f" {triples[0]} ")).cast("int"))
            either |= held >= MATCH * len(triples)
        found = F.when(family == name, either).otherwise(found)
    return found


def licence_paragraphs(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row for each paragraph: doc_id, place (from 0), paragraph, family, probability and confirmed.

    docs has doc_id and text; other columns are ignored. Paragraphs are what blank lines divide; white space alone is none,
    so null and empty texts have no rows. A family needs a probability of LEAST, else the paragraph is unknown and
    not confirmed; of families that are as likely the first in CLASSES counts. The family dual is a choice between several. A paragraph without cue words has the probability of the biases. Repeated rows and null ids give rows of
    their own. The model is fitted on the forms and at most sample paragraphs of each label; without documents on the forms alone.
    """
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), BREAK), lambda x: F.rlike(x, F.lit("\\S")))
    paragraphs = docs.select("doc_id", F.posexplode(parts).alias("place", "paragraph")).withColumn("words", normal(F.col("paragraph")))
    model = model_of(paragraphs, sample)
    bias = np.array(model["bias"])
    none = F.struct(F.lit(model["classes"][int(bias.argmax())]).alias("family"), F.lit(float(1 / np.exp(bias - bias.max()).sum())).alias("p"))
    got = paragraphs.withColumn("s", F.when(F.rlike("words", F.lit(CUE)), scored(grams(F.col("words")), model)).otherwise(none))
    family = F.when(F.col("s.p") >= LEAST, F.col("s.family")).otherwise(UNKNOWN)
    sure = F.when(F.rlike("words", F.lit(CUE)), confirmed(family, F.col("words"))).otherwise(False)
    return got.select("doc_id", "place", "paragraph", family.alias("family"), F.round("s.p", 6).alias("probability"), sure.alias("confirmed"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return licence_paragraphs(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("paragraph")
