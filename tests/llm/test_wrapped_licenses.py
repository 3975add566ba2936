"""Notices that are wrapped over lines get the labels of the method."""

from test_llm_operators import frame

from loomstead.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by"""


def test_wrapped_notices(spark):
    parted = MIT.replace("copy\nof", "copy\n *\nof")
    rows = [(1, f"Some title\n\n{MIT}\n\nbody"), (2, f"import os\n#\n{GPL}\n"), (3, MIT.replace("\n", " ")), (4, parted)]
    got = {r.doc_id: r.labels for r in licenses.license_report(frame(spark, rows)).collect()}
    assert got == {1: "mit", 2: "gpl", 3: "mit", 4: ""}
    found = licenses.license_matches(licenses.texts(frame(spark, rows[1:2])), wrapped=True).collect()
    assert [r.label for r in found] == ["gpl"]


def test_distinguishing_words(spark):
    rows = ["Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0.", "released under the license", "Released under the MIT license", "Redistribution and use in source and binary\nforms, with or without\nmodification, are permitted"]
    got = {r.doc_id: r.labels for r in licenses.license_report(frame(spark, list(enumerate(rows)))).collect()}
    assert got == {0: "", 1: "", 2: "cc-by-nc", 3: "", 4: "mit", 5: "bsd"}
