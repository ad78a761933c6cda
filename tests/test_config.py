import pytest

from wavelattice import config


def test_includes_fill_in_from_the_last_one(tmp_path):
    (tmp_path / "a.yml").write_text("s: {x: 1, y: 1}\n")
    (tmp_path / "b.yml").write_text("s: {x: 2, z: 2}\nt: {k: '3-5,1'}\n")
    (tmp_path / "m.yml").write_text("include: [a.yml, b.yml]\ns: {w: 'p \"q r\"'}\n")
    c = config.Config(str(tmp_path / "m.yml"))
    assert c.sections == {"s": {"w": 'p "q r"', "x": 2, "z": 2, "y": 1}, "t": {"k": "3-5,1"}}
    assert c.get_range("t", "k") == [1, 3, 4, 5] and c.get_list("s", "w") == ["p", "q r"]
    assert c.get("s", "x", int) == 2 and c.get("s", "nope", default=None) is None
    with pytest.raises(config.NoOption):
        c.get("s", "nope")
    with pytest.raises(config.NoSection):
        c.get("nope", "x")
    with pytest.raises(config.ConfigError):
        c.get("s", "w", int)
    with pytest.raises(TypeError):
        config.load_yaml("a: 1", b=2)
