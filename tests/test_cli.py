import json

import numpy as np
import pandas as pd

from quadrille import cli
from quadrille.sources.images import encode_png


def draw(path, fruit):
    path.parent.mkdir(parents=True, exist_ok=True)
    y, x = np.ogrid[:64, :64]
    frame = np.full((64, 64, 3), 25, np.uint8)
    frame[(x - 32) ** 2 + (y - 32) ** 2 <= 20**2] = fruit
    path.write_bytes(encode_png(frame))


def test_survey_copy_and_check(spark, tmp_path, capsys):
    down = tmp_path / "download"
    for k, folder in enumerate(("train/unripe apple", "train/rottenapples", "train/freshapples")):
        for i in range(3):
            draw(down / folder / f"{i}.png", (40, 60 + 50 * k, 200))
    draw(down / "test/rottenapples/0.png", (1, 2, 200))
    draw(down / "train/banana/0.png", (1, 200, 200))
    settings = tmp_path / "s.json"
    settings.write_text(json.dumps({"paths": {"primary_root": "staged"}, "preprocess": {"resize": [64, 64]}}))
    run = lambda *a: cli.main(["--settings", str(settings), *map(str, a)])
    assert run("check") == 1 and "no dataset" in capsys.readouterr().out
    assert run("survey", down) == 0
    assert "skipped: 1" in capsys.readouterr().out and not (tmp_path / "staged").exists()
    assert run("survey", down, "--copy", tmp_path / "staged") == 0
    assert sorted(p.name for p in (tmp_path / "staged").iterdir()) == ["RipeApple", "RottenApple", "UnripeApple"]
    assert run("survey", down, "--copy", tmp_path / "staged") == 0
    assert run("check", "--per-class", 2) == 0
    out = tmp_path / "results/segmentation_check"
    assert len(list(out.glob("*.png"))) == 3 and (out / "primary_failures.csv").read_text().startswith("path,class_folder")
    assert run("describe") == 0 and "seed: 42" in capsys.readouterr().out
    (down / "train/nothing").mkdir()
    lines = cli.tree(spark, str(down), (".png",), depth=2)
    assert [x.strip("├└─│ ") for x in lines[1:]] == ["test  1 folders", "rottenapples  1 images", "train  5 folders", "banana  1 images", "freshapples  3 images", "nothing  empty", "rottenapples  3 images", "unripe apple  3 images"]
    assert len(cli.tree(spark, str(down), (".png",), depth=1)) == 3
    draw(down / "train/unripe apple/0.png", (0, 0, 255))
    assert run("survey", down / "train/banana") == 1


def test_experiment_judges_test_side_and_other_sets(spark, tmp_path, capsys):
    sets = {"primary": ("UnripeApple", "RipeApple", "RottenApple"), "generalisation": ("FreshApple", "RottenApple"), "robustness": ("Good", "Bad", "Mixed")}
    colour = {"UnripeApple": 60, "RipeApple": 130, "FreshApple": 130, "Good": 130, "RottenApple": 200, "Bad": 200, "Mixed": 60}
    for name, classes in sets.items():
        for c in classes:
            for i in range(10 if name == "primary" else 4):
                draw(tmp_path / name / c / f"{i}.png", (40 + i, colour[c], 220 - colour[c]))
    settings = tmp_path / "s.json"
    settings.write_text(json.dumps({"paths": {f"{n}_root": n for n in sets}, "preprocess": {"resize": [48, 48]}, "augmentation": {"variants_per_image": 1}, "partition": {"cv_folds": 3, "test_size": 0.3}, "classifier": {"kernel": "linear"}}))
    assert cli.main(["--settings", str(settings), "experiment", "--technique", "T1", "--technique", "T2", "--also", "generalisation", "--also", "robustness"]) == 0
    out = tmp_path / "results/experiment"
    every = pd.read_csv(out / "scores.csv")
    scores = every[every.technique == "T1"].set_index("source")
    assert len(every) == 6 and dict(scores.n) == {"primary": 9, "generalisation": 8, "robustness": 8} and (scores.accuracy == 1).all()
    assert len(pd.read_csv(out / "folds.csv")) == 6 and (pd.read_csv(out / "matrix.csv").rows == 42).all()
    pairs, places, times = (pd.read_csv(out / f"{n}.csv") for n in ("comparisons", "ranks", "times"))
    assert pairs[["first", "second", "n"]].to_numpy().tolist() == [["T1", "T2", 3]] and pairs.p.between(0, 1).all()
    assert sorted(places.technique) == ["T1", "T2"] and places.mean_rank.sum() == 3
    assert sorted(times.technique) == ["T1", "T2"] and (times.inference_s > 0).all() and (times.judged == 9).all() and (times.trained == 42).all() and (times.n == 42).all() and (times.median_s > 0).all()
    assert not list((tmp_path).rglob("cut-*"))
    assert cli.main(["--settings", str(settings), "compare", "T2"]) == 0
    table, best = (pd.read_csv(tmp_path / f"results/sub_comparisons/T2{n}.csv") for n in ("_folds", ""))
    assert len(table) == 3 * 12 and len(best) == 12 and abs(best.mean_rank.sum() - 78) < 1e-9
    assert "share of each true class" in (out / "T1.txt").read_text() and (out / "T1.png").stat().st_size > 100
    settings.write_text(json.dumps({"paths": {"primary_root": "nowhere"}}))
    assert cli.main(["--settings", str(settings), "experiment"]) == 1 and "no dataset" in capsys.readouterr().out
