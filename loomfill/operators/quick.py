"""A quick test of a completion generator: eight fixed prompts, passed by any expected keyword."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.functions.text import format_prompt, truncate_at_blank_line
from loomfill.operators import generate
from loomfill.operators.evaluate import keyword_results

#: Name, prefix, suffix, keywords of which any suffices, language.
CASES = [
    ("Rust: Simple function body", "fn calculate_sum(numbers: &[i32]) -> i32 {\n    ", "\n}", ["iter", "sum"], "rust"),
    ("Rust: Struct field access", "impl PaymentData {\n    fn get_amount(&self) -> u64 {\n        ", "\n    }\n}", ["self.", "amount"], "rust"),
    ("Rust: Match arm", "match status {\n    Status::Success => ", ",\n    Status::Failed => Err(\"failed\"),\n}", ["Ok"], "rust"),
    (
        "Rust: Error handling",
        "fn process_payment(data: &PaymentRequest) -> Result<Response, Error> {\n    let amount = data.amount.ok_or(",
        ")?;\n    Ok(Response::new(amount))\n}",
        ["Error", "missing", "amount"],
        "rust",
    ),
    (
        "Rust: Async function",
        "async fn fetch_data(client: &Client, url: &str) -> Result<Data, Error> {\n    let response = client.get(url)",
        ";\n    response.json().await\n}",
        [".await", "send"],
        "rust",
    ),
    ("Rust: Vector operations", "fn filter_active(items: Vec<Item>) -> Vec<Item> {\n    items.into_iter()", "\n}", ["filter", "collect"], "rust"),
    (
        "Rust: Trait implementation",
        "impl Display for Transaction {\n    fn fmt(&self, f: &mut Formatter) -> fmt::Result {\n        ",
        "\n    }\n}",
        ["write!", "self"],
        "rust",
    ),
    ("Rust: Option handling", "fn get_user_name(user: Option<&User>) -> String {\n    user.map(|u| ", ").unwrap_or_default()\n}", ["name", "clone", "to_string"], "rust"),
]


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "name string, prefix string, suffix string, expected_contains array<string>, language string")


def run(spark: SparkSession, make: Callable[[], generate.Generator]) -> DataFrame:
    """``name, passed, generated, time_ms, expected_keywords`` of every case; completions end at a blank line."""
    rows = cases(spark).withColumn("sample_id", F.xxhash64("name"))
    prompts = rows.select("sample_id", format_prompt(F.col("prefix"), F.col("suffix")).alias("prompt"))
    done = generate.complete(prompts, make, "quick", k=0, greedy=generate.QUICK)
    joined = rows.join(done.select("sample_id", truncate_at_blank_line(F.col("text")).alias("generated"), "time_ms"), "sample_id")
    return keyword_results(joined)
