"""The stages as jobs, on small tables."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from evalweave.operators.rewriting import ADAPTERS
from evalweave.plans import pipelines as L
from evalweave.plans import providers as X
from evalweave.plans.providers import HashLogprobs
from evalweave.sources import corpora, sinks

COLUMNS = "id string, prompt string, starter_code_python3 string, generated_tests string, source_file string, row_index long, _src_line long, _src_file string"


def problems(spark):
    tests = json.dumps([{"input": "1", "output": "2"}])
    return spark.createDataFrame([("a", "Say 1", "def f():", tests, "s", 0, 0, "x"), ("b", " ", None, tests, "s", 1, 1, "x"), (None, "Go", None, None, "s", 2, 2, "x")], COLUMNS)


def test_tasks_resume(spark):
    tasks = L.build_tasks(problems(spark), "effibench", ADAPTERS["effibench"], "m", 3)
    rows = tasks.collect()
    assert len(rows) == 6 and {r.row_index for r in rows} == {0, 2} and all(r.prompt_used.startswith("Return ONLY") for r in rows)
    done = spark.createDataFrame([("a", 1)], "problem_id string, completion_index int")
    assert L.build_tasks(problems(spark), "effibench", ADAPTERS["effibench"], "m", 3, done, max_problems=1).count() == 2
    assert L.first_rows(problems(spark), "row_index", 2).count() == 2 and L.first_rows(problems(spark), "row_index", None).count() == 3


def test_small_rules(spark):
    assert L.with_report(ADAPTERS["mbpp"], {"recommended": {"prompt_field": "text"}}).prompt == "text" and L.with_report(ADAPTERS["mbpp"], None).prompt == "prompt"
    one = spark.range(1)
    assert one.select(L.problem_id(F.lit("mbpp"), F.lit("7"), F.lit("f"), F.lit(3)).alias("p")).first().p == "mbpp_3"
    got = one.select(L.selected_tests(F.lit(True), F.array(F.lit(1)), F.array(F.lit(2))).alias("a"), L.selected_tests(F.lit(None).cast("boolean"), F.array(F.lit(1)), F.array(F.lit(2))).alias("b"), L.bucket_position(F.lit("TIMEOUT")).alias("c"), L.bucket_position(F.lit("odd")).alias("d")).first()
    assert tuple(got) == ([1], [2], 4, 10)
    scores = spark.createDataFrame([("m", 5), ("n", 9)], "model string, n_samples int")
    assert L.same_sample_size(scores, 0).count() == 2 and L.same_sample_size(scores, 9).count() == 1


def test_probe_prefers_seen_words(spark):
    texts = spark.createDataFrame([("d", k, f"same words stand here {k % 5}") for k in range(40)] + [("e", 100 + k, f"u{k} v{k} w{k}") for k in range(40)] + [("e", 999, None)], "dataset string, i long, text string")
    rows = L.probe(texts, ["dataset"], "i", "text", HashLogprobs(), 10, k=2, seeds=2).collect()
    assert sum(r.dataset == "e" for r in rows) == 10 and all(r.delta == 0 for r in rows if r.dataset == "e")
    assert all(r.delta > 0.5 for r in rows if r.dataset == "d")


def test_family_summary(spark):
    scores = spark.createDataFrame([("m", "github", 0.9), ("m", "gsm8k", 0.2), ("m", "bbq", 0.3)], "model string, source string, score double")
    r = L.family_summary(scores, corpora.catalogue(spark)).where("family = 'pile'").first()
    assert r.auc == 1.0 and r.separation_gap == pytest.approx(60.0)


def test_jobs(spark, tmp_path, capsys):
    problems(spark).write.parquet(str(tmp_path / "in"))
    for stage in ("rewrite", "generate", "probe"):
        L.main([stage, "--input", str(tmp_path / "in"), "--output", str(tmp_path / stage)])
    assert spark.read.json(str(tmp_path / "rewrite")).count() == 3 and spark.read.json(str(tmp_path / "generate")).count() == 10
    L.main(["rewrite", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "no"), "--dry-run", "--encode-only"])
    assert not (tmp_path / "no").exists() and "Physical Plan" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        L.main(["rewrite", "--input", "x", "--output", "y", "--encode-only", "--decode-only"])


class Server(BaseHTTPRequestHandler):
    """A stub of a chat-completions server: what a prompt says decides what comes back."""

    seen: dict = {}

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        busy = "busy" in prompt or ("flaky" in prompt and self.seen[prompt] < 3)
        choice = {"message": {"content": "" if "blank" in prompt else f"```python\nx = {len(prompt)}\n```"}, "finish_reason": "stop"}
        if body.get("logprobs"):
            choice["logprobs"] = {"content": [{"token": "a", "logprob": -1.0}, {"token": "b", "logprob": -2.0}]}
        reply = json.dumps({"error": "slow down"} if busy else {"model": "m-1", "choices": [] if "none" in prompt else [choice], "usage": {"total_tokens": 3}}).encode()
        self.send_response(429 if busy else 400 if "bad" in prompt else 200)
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    server.shutdown()


def test_http_completions(spark, url):
    provider = X.Retrying(X.HttpCompletions(url, "m", timeout_s=5), attempts=3, wait=abs)
    tasks = spark.createDataFrame([(p,) for p in ("hello", "flaky", "busy", "blank", "none", "bad")], "prompt string")
    got = {r.prompt: r for r in X.generate(tasks, "prompt", provider).collect()}
    assert got["hello"].generated_solution == "x = 5" and got["hello"].finish_reason == "stop" and got["hello"].generation_metadata["model_returned"] == "m-1" and got["hello"].ast_error is None
    assert got["flaky"].error_message is None and got["busy"].error_message.startswith("RETRY_EXHAUSTED(3): HTTP_429")
    assert "No content" in got["blank"].error_message and "No candidates" in got["none"].error_message and got["bad"].error_message.startswith("HTTP_400")
    down = X.HttpCompletions("http://127.0.0.1:9/", "m", timeout_s=1).complete(["x"])[0]
    assert down.text is None and down.error.startswith("HTTP_ERROR")
    row = X.continuations(tasks.where("prompt = 'hello'"), "prompt", X.HttpCompletions(url, "m")).first()
    assert row.avg_logprob == -1.5 and [t.token for t in row.logprobs] == ["a", "b"]
    offline = {r.prompt: r for r in X.continuations(spark.createDataFrame([("a b",), (None,)], "prompt string"), "prompt", X.HashContinuations()).collect()}
    assert set(offline["a b"].continuation.split()) == {"a", "b"} and offline[None].continuation is None


def test_tests_run_until_one_fails(spark):
    kind = "array<struct<input:string,output:string>>"
    echo = "print(input())"
    rows = [(1, echo, [("a", "a"), ("b", "b")]), (2, echo, [("a", "a"), ("b", "x"), ("c", "c")]), (3, "1 / 0", [("", "")]), (4, " ", [("", "")]), (5, echo, []), (6, "while True: pass", [("", "")]), (7, "print(math.gcd(4, 6))", [(None, "2 ")])]
    df = spark.createDataFrame(rows, f"i int, code string, tests {kind}")
    got = {r.i: r for r in X.run_test_lists(df, "code", "tests", timeout_s=1, allow=True).collect()}
    assert {i: (r.status, r["pass"], r.n_run) for i, r in got.items()} == {1: ("success", True, 2), 2: ("test_failure", False, 2), 3: ("execution_error", False, 1), 4: ("empty_code", False, 0), 5: ("error", False, 0), 6: ("timeout", False, 1), 7: ("success", True, 1)}
    assert got[6].timeout and "ZeroDivisionError" in got[3].error and "Expected:\nx\nGot:\nb" in got[2].error
    with pytest.raises(PermissionError):
        X.run_test_lists(df, "code", "tests")


def test_test_stage(spark, tmp_path):
    tests = "struct<public_tests:array<struct<input:string,output:string>>,private_tests:array<struct<input:string,output:string>>,generated_tests:array<struct<input:string,output:string>>>"
    rows = [("m", "p", 0, "s", 1, "print(input())", ([("1", "1")], None, [("2", "2")])), ("m", "p", 1, "s", 1, "print(3)", ([("1", "1")], None, None))]
    df = spark.createDataFrame(rows, f"model string, problem_id string, completion_index int, source_file string, row_index long, generated_solution string, tests {tests}")
    got = {r.completion_index: (r.status, r["pass"], r.dataset, r.iso_family) for r in L.test_records(df, "bigobench", 5, allow=True).collect()}
    assert got == {0: ("success", True, "bigobench", None), 1: ("test_failure", False, "bigobench", None)}
    assert L.test_records(df, "bigobench", 5, df.select("problem_id", "completion_index").limit(1), allow=True).count() == 1
    df.write.parquet(str(tmp_path / "in"))
    L.main(["test", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--dataset", "bigobench", "--allow-run"])
    assert spark.read.json(str(tmp_path / "out")).where("pass").count() == 1
    asserts = spark.createDataFrame([("q", 0, "def f(x):\n    return x", None, ["assert f(1) == 1"]), ("q", 1, None, None, ["assert f(1) == 1"]), ("q", 2, "def f(x):\n    return 2", ["import os"], ["assert f(1) == 1"])], "problem_id string, completion_index int, generated_solution string, test_imports array<string>, test_list array<string>")
    assert [r.status for r in L.test_records(asserts, "mbpp", 5, allow=True).orderBy("completion_index").collect()] == ["success", "empty_code", "test_failure"]


def test_rounds_keep_what_was_written(spark, tmp_path):
    tasks = spark.createDataFrame([(f"p{k}", 0, "x") for k in range(20)], "problem_id string, completion_index int, prompt string")
    path = str(tmp_path / "out")
    written = []

    def write(df):
        if len(written) == 2:
            raise RuntimeError("down")
        sinks.write_jsonl(df, path, append=True)
        written.append(1)

    with pytest.raises(RuntimeError):
        X.in_rounds(tasks, ["problem_id", "completion_index"], 4, lambda t: X.generate(t, "prompt", X.EchoProvider()), write)
    kept = spark.read.json(path).count()
    assert 0 < kept < 20
    (tmp_path / "in").mkdir()
    problems(spark).write.mode("overwrite").parquet(str(tmp_path / "in"))
    L.main(["generate", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "gen"), "--rounds", "3"])
    assert spark.read.json(str(tmp_path / "gen")).count() == 10


def test_reports_of_any_length(spark, tmp_path):
    sinks.write_markdown(spark.range(12_000), str(tmp_path / "r.md"), "T")
    assert len((tmp_path / "r.md").read_text().splitlines()) == 12_004
    table = sinks.latex_table(spark.createDataFrame([("m_1", "iso", "5%"), ("m_1", "base", None), ("n", "iso", "7")], "model string, condition string, v string"), "model", "condition", "v", "C")
    assert "m\\_1 & -- & 5\\% \\\\" in table and table.startswith("% C\n\\begin{tabular}{lrr}")


def test_prompt_forms(spark):
    from evalweave.functions.code import format_prompt

    r = spark.range(1).select(format_prompt(F.lit("p"), True).alias("a"), format_prompt(F.lit("p"), False).alias("b"), format_prompt(F.lit("p"), True, "<u>{prompt}</u>").alias("c")).first()
    assert tuple(r) == ("[INST] p [/INST]", "# Python code\np\n\n", "<u>p</u>")
