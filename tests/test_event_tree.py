"""Trees of XML against a recursion over the parsed document."""

import json
from xml.etree import ElementTree

from tracemill.sources import event_tree

XML = "<E xmlns='urn:a' xmlns:b='urn:b'>lead<b:C k='1'>t<D/>tail</b:C>\n<b:C k='ü'> </b:C><F>5 &lt; 6</F><b:C><D>d</D></b:C></E>"


def plain(node):
    item = {"tag": node.tag.split("}")[-1], "attributes": dict(node.attrib)}
    if node.text and node.text.strip():
        item["text"] = node.text
    if len(node):
        item["children"] = [plain(c) for c in node]
    return item


def test_trees(spark):
    deep = "<a>" * 150 + "x" + "</a>" * 150
    texts = [XML, deep, None, "", "<a>", "a & b", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", "<a>" * 201 + "</a>" * 201]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, xml string")
    read = frame.select("id", event_tree.tree(frame.xml).alias("t"))
    found = {r.id: json.loads(r.t.toJson()) if r.t is not None else None for r in read.collect()}
    assert found == {0: plain(ElementTree.fromstring(XML)), 1: plain(ElementTree.fromstring(deep)), **dict.fromkeys(range(2, 8))}
    row = read.where("id = 0").select(event_tree.texts(read.t, "C"), event_tree.attributes(read.t, "k", "C"), event_tree.texts(read.t, "C", "D"), event_tree.texts(read.t, "F")).first()
    assert list(row) == [["t", None, None], ["1", "ü", None], [None, "d"], ["5 < 6"]]
