"""Extraction per language on our own snippets, plus notebooks, components and markup."""

import json
from textwrap import dedent

import pytest

from repograin.operators import symbols as S

# name -> (path, text, expected "line:type:name" by declared type, then place)
CASES = {
    "python": (
        "m.py",
        '''
        """Module text
        def hidden(): pass
        """
        import os
        LIMIT: int = 10   # other = 1
        a = b = 2; c = 3
        name: str
        x, y = 1, 2
        items = {
            "k": 1,
            "n": f(z=1),
        }
        items["q"] = 5
        total += 1
        class Shape(Base, metaclass=Meta):
            kind = 'round'  # comment

            def area(
                self,
                scale=1,
            ):
                self.cached = scale
                result = scale == 2
                return result

            async def load(self): return 1

        if LIMIT: flag = True
        for i in range(3): last = i
        call(
            key=1,
            other=2,
        )
        ''',
        "19:function:area 27:function:load 16:class:Shape 6:variable:LIMIT 7:variable:a 7:variable:b 7:variable:c "
        "8:variable:name 10:variable:items 17:variable:kind 24:variable:result 29:variable:flag 30:variable:last",
    ),
    "javascript": (
        "m.js",
        '''
        // function no() {}
        import x from 'y';
        const one = 1, two = call(a, b);
        let s = "const fake = 1", {p} = q;
        export default function main(a, b) {
          for (const k of list) { var inner = k; }
        }
        class Box extends Base {
          size() { return 1; }
        }
        const arrow = (n) => n + 1;
        const text = `
        const not_here = 1
        `;
        /* class Gone {} */
        export class Kept {}
        const fn = function named() {};
        ''',
        "6:function:main 9:class:Box 17:class:Kept 4:variable:one 4:variable:two 5:variable:s 7:variable:inner "
        "12:variable:arrow 13:variable:text 18:variable:fn",
    ),
    "typescript": (
        "m.tsx",
        '''
        interface Shape { area(): number; }
        type Id = string;
        enum Kind { A, B }
        const enum Fast { A }
        export abstract class Base<T> {
          private items: Map<string, T> = new Map();
          constructor(private readonly a: number) { }
          abstract todo(): void;
          public async find(
            id: string,
            deep = false,
          ): Promise<T | null> {
            if (id) { return null; }
            const found: Record<string, T[]> = {};
            return found[id];
          }
          static get size(): number { return 1; }
        }
        export const View: React.FC<Props> = ({ name, size }) => {
          const [open, setOpen] = useState(false);
          const onClick = useCallback(() => { go(); }, []);
          return <div/>;
        };
        export const load = async (id: string): Promise<void> => { };
        const old = function () { return 1; };
        function plain<T>(a: T): T { return a; }
        declare function overload(a: string): void;
        ''',
        "8:function:constructor 10:function:find 18:function:size 26:function:old 27:function:plain 6:class:Base "
        "15:variable:found 20:variable:View 22:variable:onClick 25:variable:load 26:variable:old "
        "20:component:View 25:component:load",
    ),
    "c": (
        "m.c",
        '''
        #include <stdio.h>
        struct point { int x; int y; };
        static int counter;
        int total = 0;
        char a, b;
        int add(int left, int right);
        static unsigned long *grow(
            char *buf,
            int n) {
          int local;
          if (n) { return add(n, 1); }
          return 0;
        }
        ''',
        "7:function:add 8:function:grow 4:variable:counter 6:variable:a 6:variable:b 11:variable:local",
    ),
    "java": (
        "M.java",
        '''
        package a.b;
        public class Account extends Base implements Closeable {
            private static final Map<String, Integer> CACHE = new HashMap<>();
            protected int balance, limit;
            public Account(int start) { this.balance = start; }
            @Override
            public void close() throws IOException {
                int local = 1;
                helper(local);
            }
            private List<String> names(
                    int from,
                    int to) {
                return null;
            }
            interface Inner { void signature(); }
        }
        ''',
        "8:function:close 12:function:names 17:function:signature 3:class:Account 4:variable:CACHE 5:variable:balance 5:variable:limit",
    ),
    "go": (
        "m.go",
        '''
        package main
        type Store struct { n int }
        type Reader interface { Read() error }
        func (s *Store) Get(key string) (string, error) {
            value, ok := s.find(key)
            for i, v := range s.items { _ = i }
            if err := check(); err != nil { return "", err }
            var plain = 1
            return value, nil
        }
        func main() { x := 1 }
        ''',
        "5:function:Get 12:function:main 3:class:Store 4:class:Reader 6:variable:value 6:variable:ok 8:variable:err "
        "12:variable:x",
    ),
    "rust": (
        "m.rs",
        '''
        pub(crate) struct Node<'a> { v: &'a str }
        enum Side { Left, Right }
        pub trait Walk { fn step(&self) -> u8; }
        impl<'a> Walk for Node<'a> {
            fn step(&self) -> u8 { let mut n = 1; n }
        }
        pub async fn run(
            a: u8,
        ) -> u8 {
            // let hidden = 2;
            let total: u8 = a;
            total
        }
        ''',
        "6:function:step 8:function:run 2:class:Node 3:class:Side 4:class:Walk 6:variable:n 12:variable:total",
    ),
    "ruby": (
        "m.rb",
        "\n# def no\nmodule Tools\n  class Saw < Base\n    def cut?(x)\n      y = x\n    end\n    def self.make = new\n  end\nend\n",
        "5:function:cut? 8:function:make 3:class:Tools 4:class:Saw",
    ),
    "php": (
        "m.php",
        "<?php\n// class No {}\nabstract class Repo {\n  public function find($id) {}\n  private static function make() {}\n}\nfunction help() { $a = 1; }\n",
        "4:function:find 5:function:make 7:function:help 3:class:Repo",
    ),
    "c_sharp": (
        "m.cs",
        '''
        namespace A {
            public sealed class Car : Base {
                private int speed = 1;
                public Car(int s) { speed = s; }
                public async Task<int> Drive(int km) { return await Go(km); }
            }
            internal interface IRun { void Run(); }
            struct Pt { }
        }
        ''',
        "6:function:Drive 8:function:Run 3:class:Car 8:class:IRun 9:class:Pt",
    ),
    "kotlin": (
        "m.kt",
        "\ndata class User(val id: Int)\nobject Registry {\n  fun find(\n    id: Int\n  ): User? = null\n}\nfun String.shout() = uppercase()\ninterface Named { val name: String }\n",
        "4:function:find 8:function:shout 2:class:User 3:class:Registry 9:class:Named",
    ),
    "swift": (
        "m.swift",
        "\nstruct Point { var x = 1 }\nfinal class Car {\n  init(a: Int) {}\n  func drive(\n    to place: String\n  ) -> Int {\n    return 1\n  }\n}\nprotocol Runs { func run() }\nenum Way { case up }\nextension Car {}\n",
        "5:function:drive 2:class:Point 3:class:Car 11:class:Runs 12:class:Way",
    ),
    "scala": (
        "m.scala",
        "\ncase class P(x: Int)\ntrait Runs {\n  def run(): Int\n}\nobject Main {\n  def main(args: Array[String] = Array()): Unit = println(1)\n}\n",
        "7:function:main 2:class:P 3:class:Runs 6:class:Main",
    ),
    "bash": (
        "m.sh",
        "#!/bin/bash\n# no() { x=1; }\nfunction up {\n  local n=1 m=2\n}\ndown() { COUNT=3; }\nexport PATH_X=/bin\nif [ $a == b ]; then DONE=1; fi\n",
        "3:function:up 6:function:down 4:variable:n 4:variable:m 7:variable:PATH_X 8:variable:DONE",
    ),
    "yaml": (
        "m.yml",
        "# top: no\napp:\n  name: x # note: no\n  list:\n    - id: 1\n      url: http://a:80/b\n  \"quoted\": 2\n",
        '2:key:app 3:key:name 4:key:list 5:key:id 6:key:url 7:key:"quoted"',
    ),
    "toml": (
        "m.toml",
        "title = 'a = b'\n[owner]\nage = 1 # x = 2\npoint = {left = 1, right = 2}\na.b = 1\n",
        "1:key:title 3:key:age 4:key:point 4:key:left 4:key:right",
    ),
    "sql": (
        "m.sql",
        "-- from nowhere\nCREATE TABLE IF NOT EXISTS users (id int);\nINSERT INTO logs VALUES ('from x');\nSELECT * FROM app.users u JOIN posts p ON true;\n$$ select 1 from hidden $$;\n",
        "2:table:users 3:table:logs 4:table:users 4:table:posts",
    ),
    "markdown": (
        "m.md",
        "# Top #\ntext\n```\n# in code\n```\n### Third level\n#nospace\n",
        "1:heading:Top 6:heading:Third level",
    ),
    "json": ("m.json", '{"a": {"b\\"c": [1, "x", "y"]},\n "d": ":"}', '1:key:a 1:key:b\\"c 2:key:d'),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(name, path, dedent(text)) for name, (path, text, _) in CASES.items()]
    found = S.extract_symbols(spark.createDataFrame(rows, "repo_id string, rel_path string, text string")).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.repo_id, r.type_ord, r.line, r.pos)):
        out.setdefault(r.repo_id, []).append(f"{r.line}:{r.type}:{r.name}")
    return out


def expected(text):
    """Split on the spaces between entries only; names may hold spaces."""
    import re

    return re.split(r" (?=\d+:)", text)


@pytest.mark.parametrize("name", CASES)
def test_language(extracted, name):
    assert extracted.get(name, []) == expected(CASES[name][2])


def frame(spark, *rows):
    return spark.createDataFrame(rows, "repo_id string, rel_path string, text string")


JAVA_SCOPES = """
package p;
import a.b.C;
@Service
class Store<T extends Comparable<T>> implements Closeable {
    int count, limit = 3, grid[][] = {{1}, {2}};
    final List<Map<String, Integer>> rows = new ArrayList<Map<String, Integer>>();
    @Inject
    Clock clock;
    @Value("x") long[] sizes;
    String label = "int fake = 1;"; boolean open;
    { int inBlock = 1; }
    static { long inStatic = 2; String s; }
    Store(int a) { int local = a; final int fixed = 1; this.count = local; }
    int sum(List<Integer> xs) {
        int total = 0;
        for (int i = 0; i < 3; i++) { int step = i; total += step; }
        Runnable job = new Runnable() {
            int calls;
            public void run() { int once = 1; calls += once; }
        };
        xs.forEach(x -> { int twice = 2 * x; });
        submit(new Task(1) { Object held = null; void go() { Object gone = null; } });
        class Inside { char mark; }
        return total;
    }
    enum Level {
        LOW, HIGH(2) ;
        int weight;
        Level() { int w = 1; }
    }
    record Point(int x, int y) { static int made; Point { int seen = x; } }
    interface Shape { int SIDES = 4; class Unit { int one; } }
    Runnable later = () -> { int hidden = 1; }; int after;
    int last;
"""


def test_java_fields_are_told_from_locals_by_their_scope(spark):
    deep = "class D { void f() { " + "if (a) { int no; " * 60 + "new A() { int yes; };" + "}" * 60 + " } int end; }"
    odd = "class E { \x0b int\x0bodd; \x04 int \x05 real; void f() { \x0b int no; } }"
    rows = S.extract_symbols(frame(spark, *((1, *r) for r in (("a.java", JAVA_SCOPES), ("deep.java", deep), ("odd.java", odd), ("none.java", "int x;"), ("empty.java", "")))))
    got = {}
    for r in rows.where("type = 'variable'").orderBy("file", "line", "pos").collect():
        got.setdefault(r.file, []).append(f"{r.line}:{r.name}")
    assert " ".join(got["a.java"]) == (
        "6:count 6:limit 6:grid 7:rows 9:clock 10:sizes 11:label 11:open 19:calls 23:held 24:mark 29:weight 32:made "
        "33:one 34:later 34:after 35:last"
    )
    assert [x.split(":")[1] for x in got["deep.java"]] == ["yes", "end"]
    assert [x.split(":")[1] for x in got["odd.java"]] == ["odd", "real"] and set(got) == {"a.java", "deep.java", "odd.java"}
    functions = [r.name for r in rows.where("type = 'function' AND file = 'a.java'").orderBy("line", "pos").collect()]
    classes = [r.name for r in rows.where("type = 'class' AND file = 'a.java'").orderBy("line", "pos").collect()]
    assert functions == ["sum", "run", "go"] and classes == ["Store", "Inside", "Unit"]


def test_unknown_and_case_sensitive_suffixes_give_nothing(spark):
    files = frame(spark, ("r", "a.PY", "x = 1"), ("r", "b.txt", "x = 1"), ("r", ".py", "x = 1"), ("r", "noext", "x = 1"))
    assert S.extract_symbols(files).count() == 0


def test_not_recursive(spark):
    files = frame(spark, ("r", "a.py", "x = 1"), ("r", "d/b.py", "y = 1"))
    assert [r.name for r in S.extract_symbols(files, recursive=False).collect()] == ["x"]


def test_notebook_cells_and_lines(spark):
    doc = {
        "nbformat": 4,
        "cells": [
            {"cell_type": "code", "source": ["import os\n", "a = 1"]},
            {"cell_type": "markdown", "source": "# b = 2"},
            {"cell_type": "code", "source": "   \n"},
            {"cell_type": "code", "source": "def f(\n    x=1,\n):\n    c = '''\n"},
            {"cell_type": "code", "source": ["class K:\n", "    d = 3\n"]},
        ],
    }
    files = frame(spark, ("r", "n.ipynb", json.dumps(doc)), ("r", "bad.ipynb", "{broken"), ("r", "e.ipynb", '{"cells": []}'))
    got = sorted((r.line, r.cell, r.type, r.name) for r in S.extract_symbols(files).collect())
    assert got == [
        (2, 1, "variable", "a"),
        (3, 4, "function", "f"),
        (6, 4, "variable", "c"),
        (8, 5, "class", "K"),
        (9, 5, "variable", "d"),
    ]


COMPONENT = """<template>
  <!-- <b>no</b> -->
  <Card v-if="a > 1"
        class='x'><p>hi</p></Card>
</template>

<script>
export default { name: 'X' }
const first = 1
</script>
<script setup lang="ts">
const second = () => 2
function go() {}
</script>
<style>p { color: red }</style>
"""


def test_component_blocks(spark):
    rows = S.component_symbols(frame(spark, ("r", "c.vue", COMPONENT))).collect()
    got = sorted((r.line, r.block, r.type, r.name) for r in rows)
    assert got == sorted(
        [
            (3, "template", "tag", "Card"),
            (3, "template", "attribute", 'v-if="a > 1"'),
            (4, "template", "attribute", "class='x'"),
            (4, "template", "tag", "p"),
            (4, "template", "tag", "p"),
            (4, "template", "tag", "Card"),
            (9, "script", "variable", "first"),
            (12, "script", "variable", "second"),
            (12, "script", "component", "second"),
            (13, "script", "function", "go"),
        ]
    )


def test_component_strict_language(spark):
    rows = S.component_symbols(frame(spark, ("r", "c.vue", COMPONENT)), strict=True).collect()
    assert "component" not in {r.type for r in rows}


def test_markup_masks_and_lines(spark):
    text = '<html>\n<script>var a = "<b>";</script>\n<style>i{}</style><a\n href=x data-y>\n<br/></a>'
    got = [(r.line, r.type, r.name) for r in S.extract_symbols(frame(spark, ("r", "p.html", text))).orderBy("type_ord", "pos").collect()]
    assert got == [
        (1, "tag", "html"), (2, "tag", "script"), (2, "tag", "script"), (3, "tag", "style"), (3, "tag", "style"),
        (3, "tag", "a"), (5, "tag", "br"), (5, "tag", "a"), (4, "attribute", "href=x"), (4, "attribute", "data-y"),
    ]


def test_masking_keeps_line_numbers(spark):
    text = "x = (\n1,\n[2,\n3],\n)\ny = '''\n\n'''\nz = 1\n"
    got = [(r.line, r.name) for r in S.extract_symbols(frame(spark, ("r", "a.py", text))).orderBy("line").collect()]
    assert got == [(1, "x"), (6, "y"), (9, "z")]


def test_sql_function_gives_the_same_symbols(spark):
    from repograin.plans.sql_functions import register

    register(spark)
    rows = [(name, path, dedent(text)) for name, (path, text, _) in CASES.items()]
    rows += [("vue", "c.vue", COMPONENT), ("html", "p.html", "<a\n b=1>x</a>"), ("none", "x.bin", "y = 1")]
    files = spark.createDataFrame(rows, "repo_id string, rel_path string, text string")
    files.createOrReplaceTempView("some_files")
    found = spark.sql("select repo_id, inline(found) from (select repo_id, symbols_of(rel_path, text) as found from some_files)").collect()
    got = sorted((r.repo_id, r.line, r.type, r.name, r.block or "") for r in found)
    want = sorted((r.repo_id, r.line, r.type, r.name, r.block or "") for r in S.extract_symbols(files).collect())
    assert got == want


def _names(spark, files):
    frame = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, rel_path string, text string")
    return {(r.file, r.line, r.type, r.name) for r in S.extract_symbols(frame).collect()}


def test_nests_of_any_depth_and_names_of_any_length(spark):
    lines = lambda n: "x = " + "f(\n" * n + "inner=1" + ")" * n + "\ny = 2\n"
    long = "S" * 200
    got = _names(
        spark,
        {
            "a.py": lines(200),
            "b.py": "x = " + "f(" * 300 + "inner=1" + ")" * 300 + "\ny = 2\n",
            "open.py": "(" * 3000 + "\nz = 1\n",
            "c.c": f"struct {long} {{\n int hidden;\n}};\nstruct P {{ int q; }} v, w;\ntypedef struct {{ int z;\n}} T;\nint after;\nenum E {{A, B}} e;\n",
            "d.rs": "fn a() {\n let c = '\\u{10FFFF}';\n let d = '{';\n}\nfn b() {\n}\n",
        },
    )
    assert {g for g in got if g[0] == "a.py"} == {("a.py", 1, "variable", "x"), ("a.py", 202, "variable", "y")}
    assert {g for g in got if g[0] == "b.py"} == {("b.py", 1, "variable", "x"), ("b.py", 2, "variable", "y")}
    assert {g for g in got if g[0] == "open.py"} == {("open.py", 2, "variable", "z")}
    assert {g[1:] for g in got if g[0] == "c.c"} == {(4, "variable", "v"), (4, "variable", "w"), (7, "variable", "after"), (8, "variable", "e")}
    assert {g[1:] for g in got if g[0] == "d.rs" and g[2] == "function"} == {(1, "function", "a"), (5, "function", "b")}


def test_positions_stay_apart(spark):
    text = "<a " + " ".join(f"k{i}=1" for i in range(5000)) + "><b k=1 l=2>"
    rows = S.extract_symbols(spark.createDataFrame([("r", "p.html", text)], "repo_id string, rel_path string, text string")).filter("type = 'attribute'")
    assert rows.count() == rows.select("pos").distinct().count() == 5002
    rules = S.rules_frame(spark, [("many", "word", f"(w{i}) ") for i in range(20)])
    files = spark.createDataFrame([("r", "t", "w0 w1 w2 w19 w5 w0 ", "many")], "repo_id string, rel_path string, text string, lang string")
    found = S.extract_symbols(files, rules)
    assert found.count() == found.select("pos").distinct().count() == 6
