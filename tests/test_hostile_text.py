"""Large and broken texts: extraction must finish quickly and never overflow the stack."""

import time

from repograin.operators import symbols as S

N = 60_000

TEXTS = {
    "a.py": "x = " + "(" * N,
    "b.py": "y = [" + "1," * N + "]\nz = 1\n",
    "c.py": "'" * N + "\n" + '"""' * 1001,
    "d.py": "s = '" + "\\'" * N + "'\nt = 2\n",
    "e.js": "/*" * N,
    "f.js": "const a = 1;" * 2000 + "var b = function(){" * 2000,
    "g.ts": "const f = (" + "x, " * N + ") => {}\n" + "`" * 999,
    "h.html": "<a " + 'k="v" ' * N + ">" + "<b" * N + "<!--" * N,
    "i.html": "<script>" * 2000 + "<" * N,
    "j.json": '{"a": "' + "\\\\" * N + '", "b": 1}',
    "k.c": "struct a " * 5000 + "int " * N + "x;\nint y;\n" + "{" * N,
    "l.java": "public " * N + "int a;\n" + "@A " * N,
    "m.md": "# " + "a " * N + "\n" + "```\n" * 999,
    "n.yml": "a: " + "b " * N + "\n" + "- " * 2000 + "k: v\n",
    "o.sql": "$$" * 9999 + "\nselect * from t1, " + "join " * 3000 + "t2;\n" + "/*" * N,
    "p.sh": "A=1 " * 5000 + "\n" + "(" * N,
    "q.go": "a, " * 5000 + "b := 1\n",
    "r.rs": "fn f" + "<" * N + "\nlet x = 1;\n",
    "s.cs": "public " * 5000 + "int F(" + "a, " * N,
}


def test_hostile_texts_finish(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in TEXTS.items()], "repo_id string, rel_path string, text string")
    start = time.time()
    rows = S.extract_symbols(files.repartition(4)).collect()
    assert time.time() - start < 120
    names = {(r.file, r.name) for r in rows}
    assert {("b.py", "z"), ("d.py", "t"), ("j.json", "b"), ("o.sql", "t1"), ("k.c", "y")} <= names
    assert sum(r.file == "h.html" and r.type == "attribute" for r in rows) == N
    assert sum(r.file == "p.sh" for r in rows) == 5000
