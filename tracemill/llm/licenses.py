"""Licence recognition by sentence rules. DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) with a bar at each line end, sentence
end, colon and semicolon. From every bar, the longest known sentence that ends at a bar is mapped to its
identifier; its words may go on over bars, so neither hard-wrapped lines nor abbreviations cut a sentence
in two. The document's identifiers, in order, are matched against licence rules, themselves sequences of
identifiers: rules are tried in their order, the most specific first, and a rule consumes what it matches,
so that a part of a longer licence doesn't count again as a shorter one. Unknown sentences between two
known ones break a sequence; lines without letters and digits and numbers of list items don't.

``SENTENCES`` and ``RULES`` are short mentions and stay as they are, as the SQL is written from them;
``WHOLE`` and ``WHOLE_RULES`` add the genuine sentences and titles, which the SQL doesn't have.

The work is local to a row: one scan, no shuffle, whatever the skew.

Defined cases: null and empty texts have no licence and give no row, like texts without a known
sentence; repeated rows, with or without an id, give repeated results; where two sentences or rules begin alike
the longer sentence and the earlier rule win; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl3-work": "this work is licensed under the gnu lesser general public license version 3",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
# Licence rules in the order in which they are tried.
RULES = (
    ("MIT", ("mit-permission", "mit-notice", "as-is")),
    ("MIT", ("mit-permission", "mit-notice")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("LGPL-3.0", ("lgpl3-work",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-program",)),
    ("GPL-2.0", ("gpl2-work",)),
    ("GPL-unversioned", ("gpl-free",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("proprietary", ("reserved",)),
)
# Whole genuine sentences and titles, normalised, by identifier.
_WORKS = [f"this {w}" for w in ("work", "project", "software", "program", "library", "package", "file", "code", "document")]
_VERBS = ("licensed", "released", "distributed", "made available")
_CC = {"cc-by": ("attribution",), "cc-by-sa": ("attribution sharealike", "attribution share alike"), "cc-by-nc": ("attribution noncommercial", "attribution non commercial"), "cc-by-nc-sa": ("attribution noncommercial sharealike", "attribution non commercial share alike")}
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"


def _mentions(*names: str) -> tuple[str, ...]:
    return tuple(f"{start}{verb} under {name}" for name in names for verb in _VERBS for start in ("", *(f"{w} is " for w in _WORKS)))


def _free(kind: str, version: str) -> tuple[str, ...]:
    begun, or_later = f"this program {_FREE} {kind}", "or at your option any later version"
    return tuple(
        f"{begun} {end}"
        for end in (
            f"as published by the free software foundation either version {version} of the license {or_later}",
            f"as published by the free software foundation either version {version} or at your option any later version",
            f"as published by the free software foundation version {version} of the license",
            f"as published by the free software foundation version {version}",
            f"version {version} as published by the free software foundation",
        )
    )


def _apache(use: str) -> tuple[str, ...]:
    begun = ("licensed under", "the asf licenses this file to you under", "this file is licensed to you under", "licensed to you under")
    return tuple(f"{b} the apache license version 2 0 the license{use}" for b in begun)


WHOLE = {
    "apache-header": tuple(x for w in ("this file", "these files", "this software", "this work") for x in _apache(f" you may not use {w} except in compliance with the license")),
    "apache-grant": (*_apache(""), *_mentions("the apache license version 2 0", "the apache license 2 0")),
    "apache-copy": tuple(f"you may obtain a copy of the license at {h} www apache org licenses license 2 0{x}" for h in ("http", "https") for x in ("", " txt", " html")),
    "apache-title": ("apache license version 2 0 january 2004",),
    "mit-licensed": _mentions("the mit license", "the terms of the mit license"),
    "mit-permission": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "as-is": tuple(f"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {n}" for n in ("noninfringement", "non infringement")),
    "bsd-redistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": tuple(f"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution{x}" for x in ("", " and")),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "gpl3-work": (*_free("general public license", "3"), *_mentions("the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl version 3")),
    "gpl3-title": ("gnu general public license version 3 29 june 2007",),
    "gpl2-work": (*_free("general public license", "2"), *_mentions("the gnu general public license version 2", "the gnu general public license v2", "the gnu gpl version 2")),
    "gpl2-title": ("gnu general public license version 2 june 1991",),
    "lgpl3-work": (*_free("lesser general public license", "3"), *_mentions("the gnu lesser general public license version 3", "the gnu lgpl version 3")),
    "lgpl3-title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21-work": (*_free("lesser general public license", "2 1"), *_mentions("the gnu lesser general public license version 2 1", "the gnu lgpl version 2 1")),
    "lgpl21-title": ("gnu lesser general public license version 2 1 february 1999",),
    "mpl2": (*_mentions("the mozilla public license version 2 0", "the mozilla public license v 2 0"), "this source code form is subject to the terms of the mozilla public license version 2 0"),
    "mpl2-title": ("mozilla public license version 2 0",),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    ),
    "cc0-title": ("cc0 1 0 universal",),
    **{k: tuple(x for a in names for x in _mentions(f"a creative commons {a} 4 0 international license", f"the creative commons {a} 4 0 international license", f"creative commons {a} 4 0 international", f"cc {k[3:].replace('-', ' ')} 4 0")) for k, names in _CC.items()},
    **{f"{k}-title": tuple(f"{b}{a} 4 0 international{e}" for a in names for b, e in (("creative commons ", " public license"), ("", ""))) for k, names in _CC.items()},
}
_BSD = ("bsd-redistribution", "bsd-source", "bsd-binary")
#: Tried before ``RULES``. A line of reserved rights that stands in a BSD text belongs to it.
WHOLE_RULES = (
    ("BSD-3-Clause", ("reserved", *_BSD, "bsd-endorse")),
    ("BSD-3-Clause", (*_BSD, "bsd-endorse")),
    ("BSD-2-Clause", ("reserved", *_BSD)),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-2.1", ("lgpl21-work",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    *((f"{k.upper()}-4.0", (f"{k}-title",)) for k in _CC),
    ("CC0-1.0", ("cc0-title",)),
)
# Wordings with a name in them, brought to the one that is stored. ``_`` is a space or a bar.
_NAMED = tuple(
    (p.replace("_", "[ |]"), to)
    for p, to in (
        (r"(?<=\|)neither_the_names?_of_(?:[^ |]+_){1,12}?nor_the_names_of_(?:[^ |]+_){1,4}?may_be_used_to_endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
        (r"(?<=\|)to_the_extent_possible_under_law_(?:[^ |]+_){1,12}?has_waived_all_copyright_and_related_or_neighboring_rights_to_(?:[^ |]+ ){0,11}[^ |]+(?=\|)", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
        (r"(?<=\|)(?:[^ |]+_){1,6}?is_free_software_you_can_redistribute_it", "this program is free software you can redistribute it"),
        (r"(?<=\|)copyright (?:[^ |]+ ){1,16}?all rights reserved(?=\|)", "all rights reserved"),
    )
)
_CUT = r"(?<=[.!?;:])\s+|[\r\n]+"
_BREAK = "-"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _written(ids) -> str:
    """Each identifier between bars of its own, so that matches side by side share none."""
    return "|" + "||".join(ids) + "|"


def _longest_of(sentences) -> str:
    """A pattern of all sentences, the longest first, as a tree of their words."""
    tree: dict = {}
    for x in sentences:
        node = tree
        for word in x.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def written(node: dict) -> str:
        longer = "|".join(word + written(rest) for word, rest in node.items() if word)
        return f"(?:[ |](?:{longer})){'?' if '' in node else ''}" if longer else ""

    return "|".join(word + written(rest) for word, rest in tree.items())


def _hints(sentences) -> list[str]:
    """Words of which every sentence holds one: the most frequent long word of those still without one, and so on."""
    found, left = [], [set(x.split(" ")) for x in sentences]
    while left:
        n = Counter(w for words in left for w in words if len(w) == max(map(len, words)) or len(w) > 6)
        found.append(min(n, key=lambda w: (-n[w], w)))
        left = [words for words in left if found[-1] not in words]
    return found


def _pieces(text: Column) -> Column:
    """The normalised text between bars, with single bars at its cuts."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), _CUT, "|")), r"[^\p{L}\p{N}|]+", " ")
    barred = F.regexp_replace(F.concat(F.lit("|"), plain, F.lit("|")), r" ?\|[ |]*", "|")
    for pattern, to in _NAMED:
        barred = F.regexp_replace(barred, pattern, to)
    return barred


def recognise(docs: DataFrame, sentences: dict[str, str] | None = None, rules=WHOLE_RULES + RULES) -> DataFrame:
    """(doc_id, licenses, sentence_ids, n_sentences) of every document with a known sentence.

    ``licenses`` has each licence once, in rule order; ``sentence_ids`` all known sentences in text order,
    with ``-`` for unknown sentences between them. ``sentences`` takes the place of all known ones.
    """
    ids = {x: k for k, whole in WHOLE.items() for x in whole} | {v: k for k, v in SENTENCES.items()} if sentences is None else {v: k for k, v in sentences.items()}
    by_text = _map(ids)
    # Whatever is tried starts after a bar, where the number of a list item may stand.
    pattern = rf"(?:(?:[0-9]{{1,2}}|[a-z])[ |])?({_longest_of(ids)})(?=\|)|[^|]+"

    def identify(found: Column) -> Column:
        return F.when(found == "", F.lit(_BREAK)).otherwise(F.coalesce(F.element_at(by_text, F.translate(found, "|", " ")), F.lit(_BREAK)))

    # No text without one of these words can hold a known sentence, so the others needn't be normalised.
    hinted = docs.where(F.lower(text_of()).rlike("|".join(_hints(ids))))
    cut = hinted.select("doc_id", F.regexp_extract_all(_pieces(text_of()), F.lit(pattern), F.lit(1)).alias("sentences"))
    named = cut.select("doc_id", F.transform("sentences", identify).alias("ids"))
    known = named.where(F.exists("ids", lambda i: i != _BREAK))
    rule_list = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_written(ids)).alias("ids")) for name, ids in rules])
    start = F.struct(F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply_rule(acc: Column, rule: Column) -> Column:
        here = F.contains(acc["rest"], rule["ids"])
        # What was matched becomes an unknown sentence: no later rule takes it again, or reaches across it.
        return F.when(here, F.struct(F.replace(acc["rest"], rule["ids"], F.lit(f"|{_BREAK}|")).alias("rest"), F.array_append(acc["names"], rule["name"]).alias("names"))).otherwise(acc)

    matched = known.select("doc_id", "ids", F.aggregate(rule_list, start, apply_rule)["names"].alias("names"))
    trimmed = F.regexp_replace(F.regexp_replace(F.array_join("ids", ","), r"(^|,)-(,-)*(?=,|$)", "$1-"), r"^-,?|,?-$", "")
    return matched.select("doc_id", F.array_join(F.array_distinct("names"), ",").alias("licenses"), trimmed.alias("sentence_ids"), F.size(F.filter("ids", lambda i: i != _BREAK)).cast("long").alias("n_sentences"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(documents(spark, sf_dir))


def _op5_sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    rest = "'|' || array_to_string(ids, '||') || '|'"
    steps = []
    for k, (name, ids) in enumerate(RULES):
        w = _written(ids)
        steps.append(f"r{k} AS (SELECT doc_id, ids, replace(rest, '{w}', '|{_BREAK}|') AS rest, CASE WHEN contains(rest, '{w}') THEN list_append(names, '{name}') ELSE names END AS names FROM {'r' + str(k - 1) if k else 'begun'})")
    return f"""
WITH known(id, plain) AS (VALUES {known}),
cut AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;:])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '') AS sentences FROM documents),
each AS (SELECT doc_id, rid, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS pos FROM cut),
named AS (SELECT doc_id, rid, pos, coalesce(k.id, '{_BREAK}') AS id FROM each LEFT JOIN known k ON k.plain = trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))),
seq AS (SELECT doc_id, rid, list(id ORDER BY pos) AS ids FROM named GROUP BY ALL HAVING bool_or(id <> '{_BREAK}')),
begun AS (SELECT doc_id, ids, {rest} AS rest, []::VARCHAR[] AS names FROM seq),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses,
       regexp_replace(regexp_replace(regexp_replace(array_to_string(ids, ','), '(^|,)-(,-)+(,|$)', '\\1-\\3', 'g'), '^-,?', ''), ',?-$', '') AS sentence_ids,
       len(list_filter(ids, lambda x: x <> '{_BREAK}')) AS n_sentences
FROM r{len(RULES) - 1}
"""


OP5_SQL = _op5_sql()
