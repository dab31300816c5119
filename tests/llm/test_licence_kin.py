"""Licences whose notices differ in a word or a number."""

import pytest

from patternweave.llm import license_scan

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CC = "Licensed under a Creative Commons Attribution{} 4.0 International License"
GNU = "This work is licensed under the GNU {}General Public License version {}"


@pytest.mark.parametrize(
    "text,label",
    [(CC.format(""), "cc-by"), (CC.format(" NonCommercial"), "cc-by-nc"), (CC.format(" ShareAlike"), "cc-by-sa"), ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"), (GPL.format(2), "gpl-2"), (GPL.format(3), "gpl-3"), (GNU.format("", 2), "gpl-2"), (GNU.format("", 3), "gpl-3"), (GNU.format("Lesser ", 3), "lgpl-3"), (GNU.format("Affero ", 3), "agpl-3")],
)
def test_a_notice_names_its_licence_alone(spark, text, label):
    docs = spark.createDataFrame([(1, f"Before it. {text} After it.")], "doc_id long, text string")
    assert {x.label for x in license_scan.scan_licenses(docs).first().spans} == {label}
