"""Model calls as a keyed table: how often a model is asked, and what stays after a task was killed."""

import os
from pathlib import Path

import pytest

from marginalia.plans import answers, generation


def counting(log, kill_once=None):
    """A model that notes what it is asked, answers otherwise each time, and takes its process with it once."""

    def model(name, texts):
        for t in texts:
            if t == kill_once and not Path(f"{log}.killed").exists():
                Path(f"{log}.killed").touch()
                os._exit(1)
        with open(log, "a") as f:
            f.writelines(f"{name}|{t.splitlines()[0] if t else ''}\n" for t in texts)
        n = len(Path(log).read_text().splitlines())
        return [f"<Question>{name} {t.splitlines()[0] if t else ''} {n} {k}</Question>" for k, t in enumerate(texts)]

    return model


def asked(log):
    return Path(log).read_text().splitlines() if Path(log).exists() else []


def prompts(spark, n=40):
    rows = [(k, f"m{k % 2}", f"prompt {k % 20}") for k in range(n)] + [(100, "m0", None), (101, "m0", ""), (102, None, "prompt 1")]
    return spark.createDataFrame(rows, "id int, model_id string, prompt string").repartition(3)


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    x = generation.run_model(prompts(spark), counting(log), store=store)
    first, again = (sorted((r["id"], r["output"]) for r in x.collect()) for _ in range(2))
    assert first == again and len(first) == 43
    assert len(asked(log)) == len(set(asked(log))) == 22  # null and empty are one prompt, a null model is another one
    out = dict(first)
    assert out[0] == out[20] != out[1] and out[100] == out[101]
    more = prompts(spark).unionByName(spark.createDataFrame([(200, "m1", "new")], "id int, model_id string, prompt string"))
    assert dict((r["id"], r["output"]) for r in generation.run_model(more, counting(log), store=store).collect())[5] == out[5]
    assert len(asked(log)) == 23
    assert generation.run_model(more.limit(0), counting(log), store=store).count() == 0


def test_a_killed_task_repeats_no_answer(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    model = counting(log, kill_once="prompt 13")
    with pytest.raises(Exception, match=r"(?i)crash|exit|abort"):
        answers.ask(prompts(spark), model, store, batch_rows=1, tasks=1)
    before = asked(log)
    assert 0 < len(before) < 22
    got = answers.ask(prompts(spark), model, store, batch_rows=1, tasks=1).collect()
    assert all(r["output"] for r in got) and sorted(asked(log)) == sorted(set(asked(log))) and len(asked(log)) == 22
    assert asked(log)[: len(before)] == before


def test_a_task_that_runs_again_reads_its_files(spark, tmp_path):
    """What a lost executor's task does when it is run again over the same prompts."""
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    run = answers._asker(counting(log), store, 2, "run")
    batch = answers.pa.RecordBatch.from_pydict({"key": list("abcde"), "model_id": ["m"] * 5, "prompt": list("vwxyz")})
    for _ in range(2):
        assert sum(b.column("n")[0].as_py() for b in run(iter([batch]))) == 5
    assert len(asked(log)) == 5 and answers.answers(spark, store).count() == 5


def test_failures_are_asked_again(spark, tmp_path):
    store, up = str(tmp_path / "store"), tmp_path / "up"

    def model(name, texts):
        if not up.exists():
            raise RuntimeError("down")
        return ["fine"] * len(texts)

    x = spark.createDataFrame([("m", "p", "own")], "model_id string, prompt string, output string")
    assert "failed: down" in answers.ask(x, model, store).first()["output"]
    up.touch()
    assert answers.ask(x, model, store).first()["output"] == "fine"
    assert answers.ask(x, lambda name, texts: ["other"], store).first()["output"] == "fine"


def test_board_reviews_what_it_settles_on(spark, tmp_path):
    """A model whose answers differ from call to call: one proposal a request, and the reviews are of it."""
    log = str(tmp_path / "log")
    count = counting(log)

    def model(name, texts):
        said = count(name, texts)
        return [f"<Feedback>{t.splitlines()[2]}</Feedback>" if t.startswith("Review") else "" if t.startswith("Settle") else s for t, s in zip(texts, said, strict=True)]

    rows = [(k, f"ask {k}", "chair", ["a", "b"], 3) for k in range(20)]
    got = generation.board(spark.createDataFrame(rows, "request_id int, prompt string, chairman string, members array<string>, num_questions int"), model)
    got = got.collect()
    assert len(got) == 20 and sum(x.startswith("chair|ask") for x in asked(log)) == 20
    assert all(f"<Question>{r['question']}</Question>" == v["feedback"] for r in got for v in r["reviews"])
    assert all(r["question"].startswith(f"chair ask {r['request_id']} ") for r in got)
