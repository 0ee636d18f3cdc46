"""Node extraction on inline sources."""

import textwrap

from loomfill.operators import extract as X
from loomfill.operators.blocks import extract_blocks


def rust(code):
    return X.rust_nodes(textwrap.dedent(code).lstrip("\n"))


def short(nodes):
    return [(n[0], n[1], n[2]) for n in nodes]


def test_items_and_visiting_order():
    got = rust(
        """
        use std::collections::HashMap;
        mod outer {
            pub mod inner { pub const A: u8 = 1; }
            static mut B: [u8; 2] = [1, 2];
            type C = Vec<u8>;
        }
        pub enum E { X, Y { z: u8 } }
        """
    )
    assert short(got) == [
        ("Use", "use std :: collections :: HashMap ;", "1:1"),
        ("Mod", "outer", "2:6"),
        ("Mod", "inner", "3:3"),
        ("Const", "A", "3:3"),
        ("Const", "B", "4:4"),
        ("Other", "C", "5:5"),
        ("Enum", "E", "7:7"),
    ]


def test_impl_methods_come_before_nested_items():
    got = rust(
        """
        impl<T: Into<u8>> Tr<T> for S<T> where T: Copy {
            const N: u8 = 3;
            fn one(&self, x: u8, (a, b): (u8, Vec<u8>)) -> Result<u8, ()> {
                fn helper() {}
                Ok(x)
            }
            #[inline]
            pub async unsafe fn two<'a>(self) {
                struct L;
            }
        }
        """
    )
    assert short(got) == [
        ("Impl", "S < T >", "1:11"),
        ("Function", "one", "3:6"),
        ("Function", "two", "8:10"),
        ("Function", "helper", "4:4"),
        ("Struct", "L", "9:9"),
    ]
    assert got[1][4] == [("self", "& self"), ("x", "u8"), ("( a , b )", "( u8 , Vec < u8 > )")]
    assert got[1][5] == "Result < u8 , ( ) >" and got[2][5] == "()"
    assert got[1][3].startswith("{ fn helper")


def test_trait_methods_are_not_functions():
    got = rust(
        """
        pub unsafe trait T {
            fn a(&self);
            fn b(&self) { fn inner() {} }
        }
        """
    )
    assert [n[:2] for n in got if n[0] != "Function"] == [("Trait", "T")]
    assert "b" not in [n[1] for n in got]


def test_spans_of_attributes_and_comments():
    got = rust(
        """
        /// Says what f is.
        #[test]
        fn f() {
        }
        /// Says what S is.
        #[derive(Clone)]
        pub struct S { a: u8 }
        """
    )
    assert short(got) == [("Function", "f", "3:4"), ("Struct", "S", "5:7")]


def test_literals_that_look_like_structure():
    got = rust(
        """
        fn f<'a>(x: &'a str) -> char {
            let r = r#"} fn g() { "#;
            let c = '{'; let q = '\\''; let b = b"}\\"";
            /* fn h() { /* nested */ } */
            // fn i() {
            'x
            : loop { break; }
            c
        }
        fn k() where [(); { 1 }]: Sized { }
        macro_rules! m { () => { fn hidden() {} } }
        """
    )
    assert [n[1] for n in got if n[0] == "Function"] == ["f", "k"]


def test_malformed_and_empty():
    assert rust("fn f() {") is None
    assert rust('let s = "') is None
    assert rust("") == []
    assert rust("fn f() {}") == [("Function", "f", "1:1", "{  }", [], "()")]
    assert rust("fn f() {\r\n}\r\n")[0][2] == "1:2"
    assert rust("use a::{b, c};" + " " * 10)[0][1] == "use a :: { b , c } ;"
    assert len(rust("use " + "a::" * 80 + "b;")[0][1]) == 100


def test_python_nodes():
    code = textwrap.dedent(
        """
        import a
        from b import c
        @deco
        def f():
            x = 1
        async def g():
            async for i in y: pass
            async with z: pass
        class C:
            if a: pass
            for i in y: pass
            while a: pass
            with z: pass
            try: pass
            except E: pass
            match a:
                case 1: pass
        """
    ).lstrip("\n")
    kinds = [n[0] for n in X.python_nodes(code)]
    assert set(kinds) == set(X.PYTHON_NODES)
    assert kinds[:4] == ["Import", "ImportFrom", "FunctionDef", "Assign"]
    assert X.python_nodes(code)[2][2] == "4:5"
    assert X.python_nodes("def f(:") is None and X.python_nodes("x") == []


def test_extraction_in_workers(spark):
    files = spark.createDataFrame([("a.rs", "fn long_name() {\n    let x = 12345;\n}\n"), ("b.rs", "fn f() {"), ("c.rs", "1 + 1;"), ("d.rs", None)], "path string, code string")
    parsed = X.extract_nodes(files, "rust")
    assert [r.path for r in parsed.collect()] == ["a.rs"]
    assert X.explode_nodes(parsed).first().span == "1:3"
    assert [r.node_type for r in extract_blocks(parsed).collect()] == ["FunctionBody"]
    py = spark.createDataFrame([("a.py", "def f():\n    return 1\n")], "path string, code string")
    assert X.explode_nodes(X.extract_nodes(py, "python", alias_functions=True)).first().node_type == "Function"


def test_table_functions(spark):
    X.register_udtfs(spark)
    got = spark.sql("SELECT n.* FROM VALUES ('fn f() {}') AS t(c), LATERAL rust_items(c) AS n").collect()
    assert [(r.node_type, r.name, r.span) for r in got] == [("Function", "f", "1:1")]
    got = spark.sql("SELECT n.* FROM VALUES ('import a') AS t(c), LATERAL python_ast_nodes(c) AS n").collect()
    assert [(r.node_type, r.span) for r in got] == [("Import", "1:1")]
