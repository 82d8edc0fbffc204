"""Imports of Python and Go texts, and their rewriting."""

from codeloom.sources import imports

PYTHON = '''import os
import a.b as c, d  # e, f
from . import (  # brackets
    one,
    two as t,
)
from .pkg.mod import x; import late
from ...top import y
s = """
import hidden
""" ; import not_at_start
x = """one line"""
def f():
    from inner import g
\'\'\' open
from hidden import h
closing \'\'\'
from long \\
    import name
# import comment
important = 1
from .. import *
from q import (never,
  closed
'''

GO = '''package main
import "fmt"
import alias "net/http" // "no"
import _ `raw/path`
/* import "hidden"
import "hidden2" */
import (
    "os"
    . "dot/pkg"
    // "comment"

    name "example.com/mod/sub" // trailing )
)
import ("one/line")
var x = "import"
    "outside"
'''


def found(frame):
    return sorted((r.line, r.specifier) for r in frame.collect())


def test_python_imports(spark):
    files = spark.createDataFrame([("m.py", PYTHON), ("n.py", None), ("e.py", "")], "path string, text string")
    want = [(1, "os"), (2, "a.b"), (2, "d"), (3, "./one"), (3, "./two"), (7, "./pkg/mod"), (7, "late"), (8, "../../top"), (14, "inner"), (18, "long")]
    assert found(imports.python_imports(files, "path")) == want
    crlf = files.selectExpr("path", "replace(text, '\n', '\r\n') AS text")
    assert found(imports.python_imports(crlf, "path")) == want


def test_go_imports(spark):
    files = spark.createDataFrame([("m.go", GO), ("n.go", None)], "path string, text string")
    assert found(imports.go_imports(files, "path")) == [(2, "fmt"), (3, "net/http"), (4, "raw/path"), (8, "os"), (9, "dot/pkg"), (12, "example.com/mod/sub"), (14, "one/line")]


def test_longest_root_holds(spark):
    rows = [("cmd/app/main.go", "example.com/mod"), ("cmd/app/main.go", "example.com/mod/pkg/x"), ("pkg/y.go", "example.com/mod/pkg/x"), ("main.go", "example.com/module"), ("main.go", "example.com/mod/own/z"), ("main.go", "./local"), ("cmd/app/main.go", "example.com/mod/cmd/app")]
    roots = spark.createDataFrame([("example.com/mod", ""), ("example.com/mod/own", "vendored")], "name string, root string")
    got = imports.below_roots(spark.createDataFrame(rows, "path string, specifier string"), roots, "/")
    assert sorted(map(tuple, got.collect())) == sorted([("cmd/app/main.go", "../.."), ("cmd/app/main.go", "../../pkg/x"), ("pkg/y.go", "./x"), ("main.go", "example.com/module"), ("main.go", "./vendored/z"), ("main.go", "./local"), ("cmd/app/main.go", ".")])
