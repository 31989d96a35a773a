"""Any well-formed XML fragment as a tree in VARIANT: objects of tag, attributes, text and children in order.

Names lose their namespaces. ``text`` is what stands before the first child, kept only if it isn't blank, as
``children`` is only where there are any. Null, malformed or empty text, a document type (which may expand
without bound) and more than 200 levels give null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 200


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _tree(xml: str | None) -> str | None:
    if not xml or "<!DOCTYPE" in xml:
        return None
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        parser.feed(xml)
        parser.close()
        open_, root = [], None
        for event, element in parser.read_events():
            if event == "start":
                open_.append(node := {"tag": _local(element.tag), "attributes": dict(element.attrib)})
                if len(open_) > DEEPEST:
                    return None
                if len(open_) > 1:
                    open_[-2].setdefault("children", []).append(node)
            else:
                root = open_.pop()
                if element.text and element.text.strip():
                    root["text"] = element.text
    except ElementTree.ParseError:
        return None
    return json.dumps(root, ensure_ascii=False)


def tree(xml: Column) -> Column:
    """The tree of a text column, read by Arrow batches."""

    @F.pandas_udf("string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(_tree, na_action="ignore")

    return F.try_parse_json(read(xml))


def nodes(of: Column, *path: str) -> Column:
    """All elements below a tree's root under a path of tags, in order, as trees."""
    found = F.array(of)
    below = lambda node: F.coalesce(F.try_variant_get(node, "$.children", "array<variant>"), F.array().cast("array<variant>"))
    for tag in path:
        found = F.filter(F.flatten(F.transform(found, below)), _tagged(tag))
    return found


def _tagged(tag: str):
    return lambda node: F.try_variant_get(node, "$.tag", "string") == tag


def texts(of: Column, *path: str) -> Column:
    """The texts of the elements under a path; null for one without."""
    return F.transform(nodes(of, *path), lambda node: F.try_variant_get(node, "$.text", "string"))


def attributes(of: Column, name: str, *path: str) -> Column:
    """An attribute of the elements under a path; null for one without."""
    return F.transform(nodes(of, *path), lambda node: F.try_variant_get(node, f"$.attributes.{name}", "string"))
