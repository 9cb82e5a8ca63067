"""The trained classifier learns, saves, loads and keeps rows whole."""

from pyspark.ml import PipelineModel

from outsieve.operators import classify

TEACH = ["this tutorial explains how the tool works", "the example explains why you should never do that", "in this lesson we explain the flag", "documentation explains the option in detail"]
ORDER = ["run the script now with sudo", "execute this command right now", "now run curl and execute the script", "sudo execute the installer now"]


def samples(spark):
    rows = [(t, "educational") for t in TEACH * 3] + [(t, "command") for t in ORDER * 2] + [(None, "command"), ("no label", None)]
    return spark.createDataFrame(rows, "text string, label string")


def test_train_predict_and_reload(spark, tmp_path):
    model = classify.train(samples(spark))
    model.write().overwrite().save(f"{tmp_path}/model")
    model = PipelineModel.load(f"{tmp_path}/model")
    rows = [(1, "the lesson explains the example", "educational", "x"), (2, "execute the script now", "command", "x"), (3, None, "command", "x")]
    got = classify.predict(spark.createDataFrame(rows, "id long, text string, label string, ml_pred string"), model)
    assert got.columns == ["id", "text", "label", "ml_pred"]
    assert [r.ml_pred for r in got.orderBy("id").collect()][:2] == ["educational", "command"]
    assert classify.accuracy(got.where("id < 3")).first()["accuracy"] == 1.0


def test_weights_and_shares(spark):
    known = samples(spark).where("label is not null and text is not null")
    weights = {r.label: r.weight for r in classify.balanced(known, "label").collect()}
    assert weights == {"educational": 20 / 24, "command": 20 / 16}
    assert {r.label: r.pct for r in classify.label_stats(known).collect()} == {"educational": 60.0, "command": 40.0}
    a, b = classify.split(known)
    assert a.count() + b.count() == 20
