from folioscope.llm import handwritten as H

PACKAGES = H.package_pattern(["zipkit", "charto", "momenta-lite", None, ""])
HAND = """using System;
namespace A {
  /// <summary>Parses generated files; do not edit by hand elsewhere.</summary>
  public class Parser {
    private readonly int _limit = 3;
    public int Run(string text) {
      foreach (var line in text.Split('\\n')) {
        if (line.Length > _limit) { Count++; } else throw new Exception("too short");
      }
      return Count * 2;
    }
    public int Count { get; set; }
  }
}
"""
MINIFIED = "".join(f"function f{i}(a,b){{return a.x?b[{i}]:void 0}};var g{i}=f{i}(1,2);" for i in range(40))
GENERATED = "\n".join(f"export const item_{i}: D = {{ no: {i}, name: \"n{i}\", kind: 4 }};" for i in range(30))
DATA = "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, 'some words here {i}', 3.{i}, '2024-01-{i % 28 + 1:02d}')" for i in range(60))


def test_reasons():
    assert H.reason("/p/src/A.cs", HAND, PACKAGES) is None
    assert H.reason("/p/src/a.js", MINIFIED, PACKAGES) == "minified"
    assert H.reason("/p/src/a.ts", GENERATED, PACKAGES) == "generated"
    assert H.reason("/p/src/a.ts", "// DO NOT EDIT. Run `X emit` to refresh.\n" + GENERATED, PACKAGES) == "generated"
    assert H.reason("/p/db/a.sql", DATA, PACKAGES) == "data"
    assert H.reason("/p/src/a.ts", "const x = `" + "QUJD" * 300 + "`;", PACKAGES) == "data"


def test_vendored_by_path_and_banner():
    assert H.reason("/p/node_modules/zipkit/lib/a.cs", HAND, PACKAGES) == "vendored"
    assert H.reason("/p/deps/momenta-lite-2.1.0/a.cs", HAND, PACKAGES) == "vendored"
    assert H.reason("/p/src/vendors/A.cs", HAND, PACKAGES) is None
    assert H.reason("/p/src/A.cs", "/*! charto v1.2 | licence MIT */\n" + HAND, PACKAGES) == "vendored"
    assert H.reason("/p/src/A.cs", "// uses charto for the drawing\n" + HAND, PACKAGES) is None
    assert H.reason("/p/src/chartotype/A.cs", HAND, PACKAGES) is None


def test_edges():
    assert H.reason(None, None, PACKAGES) is None and H.reason("/p/a.cs", "", None) is None and H.reason("/p/a.cs", "  \n", PACKAGES) is None
    assert H.reason("/p/a.js", "x" * 300_000, PACKAGES) is None
    assert H.reason("/p/a.js", "\"unclosed", PACKAGES) is None
    assert H.package_pattern([]) is None


def test_table(spark):
    docs = spark.createDataFrame(
        [(1, "code", "/p/a.js", MINIFIED, "r"), (1, "code", "/p/a.js", MINIFIED, "r"), (2, "document", "/p/b.md", MINIFIED, "r"), (3, "code", None, GENERATED, "r"), (4, "code", "/p/vendor/zipkit/x.cs", None, "r"), (5, None, "/p/c.js", MINIFIED, None)],
        "doc_id bigint, document_type string, path string, text string, reason string",
    )
    packages = spark.createDataFrame([("zipkit",), (None,)], "package_name string")
    assert sorted((r.doc_id, r.reason) for r in H.unwritten_files(docs, packages).collect()) == [(1, "minified"), (3, "generated"), (4, "vendored")]
    assert H.unwritten_files(docs.limit(0), packages.limit(0)).count() == 0


def test_whole_leading_comment_is_searched():
    licence = "\n".join(f"// Line {i} of a long notice about the terms of use." for i in range(60)) + "\n"
    mixed = GENERATED + "\nlet a = 1;\nif (a) b();\nfor (;;) c[0]++;\nd.e(f, 2);\nwhile (g) { h(); }\n"
    assert H.Layout(mixed).uniform < H.UNIFORM_SHARE
    assert H.reason("/p/src/a.ts", licence + mixed, PACKAGES) is None
    assert H.reason("/p/src/a.ts", licence + "// Code generated by emit. DO NOT EDIT.\n" + mixed, PACKAGES) == "generated"
    assert H.reason("/p/src/A.cs", licence + "// charto v1.2, copyright its authors\n" + HAND, PACKAGES) == "vendored"
