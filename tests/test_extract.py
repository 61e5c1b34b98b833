"""Extractors on small sources."""

from lodeweave.sources.extract import extract


def names(got):
    return [(s.name, s.kind, s.line) for s in got.symbols]


def calls(got, name):
    return [(c.name, c.qualifier, c.receiver, c.arity, c.line) for s in got.symbols if s.name == name for c in s.calls]


def test_python():
    got = extract("python", "a.py", b'''import os, a.b
import numpy as np
from util import foo as myfoo, bar
from . import here


class Box(Base, meta=M):
    """
    A box.
    """

    @wraps
    def get(self, x: int = f(1)) -> dict[str, int]:
        def inner():
            deep()
        return self.load(x)[0].strip()

def run(): "Run it."; helper(1, *a, k=2)
if True:
    async def later(): pass
''')
    assert names(got) == [("Box", "class", 7), ("get", "method", 13), ("run", "func", 18), ("later", "func", 20)]
    assert [s.signature for s in got.symbols] == ["class Box(Base, M)", "def get(self, x: int = f(1)) -> dict[str, int]", "def run()", "async def later()"]
    assert [s.doc for s in got.symbols] == ["A box.", "", "Run it.", ""]
    assert ("load", "self", "self", 1, 16) in calls(got, "get") and ("deep", "", "", 0, 15) in calls(got, "get") and ("strip", "self.load(x)[0]", "", 0, 16) in calls(got, "get")
    assert calls(got, "run") == [("helper", "", "", 3, 18)]
    assert got.imports == ["os", "a.b", "util", ".", "numpy"] or set(got.imports) == {"os", "a.b", "util", ".", "numpy"}
    assert got.aliases == {"os": "os", "b": "a.b", "np": "numpy", "util": "util", "myfoo": "util#foo", "bar": "util#bar", "here": ".#here"}


def test_broken_python():
    got = extract("python", "a.py", b"class A:\n    def f(self):\n        return (\n\ndef g(:\n")
    assert names(got) == [("A", "class", 1), ("f", "method", 2), ("g", "func", 5)] and got.issue.startswith("a.py")


def test_go():
    got = extract("go", "a.go", b'''package demo

import (
	"context"
	f "fmt"
	_ "embed"
)

// func Comment() { no() }
type Service interface {
	Run(ctx context.Context) error
}

type (
	Worker struct { n int }
	ID     string
)

func (w *Worker) Run(ctx context.Context) (int, error) {
	logStart("func Text() {", func() int { return inner() })
	for i := range list { w.next.step(i, 2) }
	return helper(ctx)
}

func helper[T any](x T) error { f.Println("}"); if ok() { return nil }; return nil }
''')
    assert names(got) == [("Service", "interface", 10), ("Worker", "struct", 15), ("ID", "struct", 16), ("Run", "method", 19), ("helper", "func", 25)]
    assert [s.signature for s in got.symbols] == ["type Service interface", "type Worker struct", "type ID string", "(w *Worker) func Run(ctx context.Context) (int, error)", "func helper(x T) error"]
    assert calls(got, "Run") == [("logStart", "", "", 2, 20), ("inner", "", "", 0, 20), ("step", "w.next", "w.next", 2, 21), ("helper", "", "", 1, 22)]
    assert calls(got, "helper") == [("Println", "f", "f", 1, 25), ("ok", "", "", 0, 25)]
    assert got.imports == ["context", "fmt", "embed"] and got.aliases == {"context": "context", "f": "fmt", "embed": "embed"}


def test_typescript():
    got = extract("typescript", "a.ts", b'''import core, { foo, bar as baz } from "./util";
import * as all from 'lib/all';
import "side";

export interface Store { save(value: string): void; }
type Pair = [string, string];

export class Memory<T> extends Base implements Store {
  private n = make(1);
  constructor(a: string) { super(a); this.load(); }
  async save(value: string): Promise<string> {
    if (x) { log(formatKey(value)); }
    return this.store.put(value)
  }
}

export function formatKey(value: string): string {
  function nested() { hidden(); }
  return value.trim().toLowerCase();
}
export const buildPath = (root: string, key: string): string => join(root, formatKey(key));
const old = function (a) { go(a, b) };
const number = 5;
''')
    assert names(got) == [("Store", "interface", 5), ("Pair", "struct", 6), ("Memory", "class", 8), ("constructor", "method", 10), ("save", "method", 11), ("formatKey", "func", 17), ("buildPath", "func", 21), ("old", "func", 22)]
    signatures = {s.name: s.signature for s in got.symbols}
    assert signatures["save"] == "save(value: string): Promise<string>" and signatures["formatKey"] == "function formatKey(value: string): string" and signatures["Memory"].endswith("extends Base implements Store")
    assert ("load", "this", "this", 0, 10) in calls(got, "constructor")
    assert calls(got, "save") == [("log", "", "", 1, 12), ("formatKey", "", "", 1, 12), ("put", "this.store", "", 1, 13)]
    assert [c[:2] for c in calls(got, "formatKey")] == [("hidden", ""), ("trim", "value"), ("toLowerCase", "value.trim()")]
    assert calls(got, "buildPath") == [("join", "", "", 2, 21), ("formatKey", "", "", 1, 21)] and calls(got, "old") == [("go", "", "", 2, 22)]
    assert got.imports == ["./util", "lib/all", "side"] and got.aliases == {"core": "./util", "foo": "./util", "baz": "./util", "util": "./util", "all": "lib/all", "side": "side"}


def test_javascript_from_fixture_like_text():
    got = extract("javascript", "a.js", b'import fs from "fs";\n\nexport function readText(path) {\n  const value = fs.readFileSync(path, "utf8");\n  return normalize(value);\n}\n\nexport const normalize = (value) => value.trim();\n')
    assert names(got) == [("readText", "func", 3), ("normalize", "func", 8)]
    assert calls(got, "readText") == [("readFileSync", "fs", "", 2, 4), ("normalize", "", "", 1, 5)]
    assert [c[:2] for c in calls(got, "normalize")] == [("trim", "value")]


def test_ruby():
    got = extract("ruby", "a.rb", b'''require "json"
require_relative "helpers/format"

module Fixtures
  class Processor < Base
    def run(value)
      payload = normalize(value) # call(no)
      return if payload.nil?
      items.each do |x|
        self.emit x, 2
      end
      JSON.dump(payload)
    end

    def self.build(a) = new(a)

    def normalize(value)
      if value
        value.strip.downcase
      end
    end
  end
end

def top
  log "end"
end
''')
    assert names(got) == [("Fixtures", "module", 4), ("Processor", "class", 5), ("run", "method", 6), ("self.build", "method", 15), ("normalize", "method", 17), ("top", "func", 25)]
    assert [s.signature for s in got.symbols] == ["module Fixtures", "class Processor < Base", "def run(value)", "def self.build(a)", "def normalize(value)", "def top"]
    found = calls(got, "run")
    assert ("normalize", "", "", 1, 7) in found and ("dump", "JSON", "", 1, 12) in found and ("emit", "self", "self", 2, 10) in found and ("nil?", "payload", "", 0, 8) in found
    assert [c[:2] for c in calls(got, "normalize")] == [("strip", "value"), ("downcase", "value.strip")]
    assert [c[0] for c in calls(got, "top")] == ["log"]
    assert got.imports == ["json", "helpers/format"] and got.aliases == {"json": "json", "format": "helpers/format"}


def test_awkward():
    for language in ("python", "go", "ruby", "typescript", "javascript"):
        for content in (b"", b"\xff\xfe\x00", b"((((", b'"', b"func (", b"/*", b"class", b"def f(", b"x" * 100_000):
            extract(language, "x", content)
    assert extract("cobol", "x", b"").issue


def test_scripts_with_expressions_templates_and_type_arguments():
    source = """
export function first(rows: string[]): string {
  const pattern = /[/"'`(]{2}\\/fake(1)/g;
  const half = total(rows) / count(rows) / 2;
  return wrap<Map<string, number>>(`a ${inner(rows, `${deep()}`)} outside(1)`, pattern) + rest;
}

function second() {
  return /x(/.test(name()) ? make<Thing>() : a < b && c > (d);
}
"""
    got = extract("typescript", "a.ts", source.encode())
    assert [(s.name, s.line, [c.name for c in s.calls]) for s in got.symbols] == [
        ("first", 2, ["total", "count", "wrap", "inner", "deep"]), ("second", 8, ["test", "name", "make"]),
    ]
    assert next(c.arity for c in got.symbols[0].calls if c.name == "wrap") == 2


def test_ruby_with_heredocs_and_literals():
    source = """
class A
  def one
    text = run(<<~SQL, 2)
      def not_a_method(x)
        fake(1)
      end
    SQL
    check(text)
    words = %w[fake(2) end def]
    words << VALUE
    return match(/def (fake)(3)/, total(4) / 2) if text =~ /end "/
  end

  def two
    other(<<-ONE, <<TWO)
      class Fake
      ONE
  end fake(4)
TWO
    last(100 % 7)
  end
end
"""
    got = extract("ruby", "a.rb", source.encode())
    assert [(s.kind, s.name, s.line, [(c.name, c.arity) for c in s.calls]) for s in got.symbols] == [
        ("class", "A", 2, []), ("method", "one", 3, [("run", 2), ("check", 1), ("match", 2), ("total", 1)]), ("method", "two", 15, [("other", 2), ("last", 1)]),
    ]
