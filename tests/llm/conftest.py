import pandas as pd
import pytest

WORDS = [f"w{i}" for i in range(400)]


def words(seed: int, n: int) -> list[str]:
    return [WORDS[(seed * 7919 + i * i * 31 + i * seed) % 400] for i in range(n)]


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """Documents with nulls, empty and long texts, repeats, near copies and an extra column; and the other tables."""
    texts = [" ".join(words(i, 30 + i % 50)) for i in range(60)]
    base = words(3, 200)
    for k in range(20):  # a hub and copies of it that lie further from one another
        texts.append(" ".join(base[: 7 * k] + [f"own{k}"] * 3 + base[7 * k + 3 :]))
    passage = " ".join(words(11, 80))
    texts += [" ".join(base), " ".join(base), passage + " end", "start " + passage + " " + passage, None, "", "one", "one", "É ÜBER Über", "x " * 30000]
    texts += ["mail bob@example.com or +44 20 7946 0958, 10.1.2.3 and 4111 1111 1111 1111", "you stupid idiot"]
    path = tmp_path_factory.mktemp("docs")
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t or "") for t in texts], "node": "clash"})
    frame.to_parquet(path / "documents.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "quality": 1, "toxic": [int("stupid" in (t or "")) for t in texts]}).to_parquet(path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [passage]}).to_parquet(path / "benchmark.parquet")
    return str(path)


@pytest.fixture(scope="session")
def texts(folder):
    frame = pd.read_parquet(f"{folder}/documents.parquet")
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(frame.doc_id, frame.text)}
