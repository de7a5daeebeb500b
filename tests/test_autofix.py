import pytest
from tidemark.static import autofix


def test_seeds_calls_and_nothing_else(tmp_path):
    src = "é = 1; a, b = split(x, y)\nc = split()\nd = split(\n    x,  # one, two\n    y,\n)\ne = split(x, random_state=3)\nf = split(**k)\n"
    places = [(1, 15), (2, 4), (3, 4), (7, 4), (8, 4)]
    want = "é = 1; a, b = split(x, y, random_state=0)\nc = split(random_state=0)\nd = split(\n    x,  # one, two\n    y,\nrandom_state=0)\ne = split(x, random_state=3)\nf = split(**k)\n"
    assert autofix.seeded(src, places) == want
    p = tmp_path / "a.py"
    p.write_text(src)
    with pytest.raises(autofix.FixError):
        autofix.apply(p, places, "other")
    assert autofix.apply(p, places, autofix.digest(src)) and p.read_text() == want
    assert not autofix.apply(p, places, autofix.digest(want))
    assert [x.name for x in tmp_path.iterdir()] == ["a.py"]
    with pytest.raises(autofix.FixError):
        autofix.apply(tmp_path / "n.ipynb", [], "")
