"""Short notices are told apart by their names and versions."""

import pytest

from volpanel.llm import licenses

INDEX = licenses.compile_index(licenses.TEMPLATES)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found_as_itself(name):
    assert [s[0] for s in licenses.scan_texts(INDEX, [f"x. {licenses.TEMPLATES[name]} y"])[0]] == [name]


def test_other_names_and_versions_are_not_reported():
    texts = ["Licensed under the Foo License, Version 2.0.", "This work is licensed under the GNU General Public License, version 1.", "Released under the Foo License."]
    assert licenses.scan_texts(INDEX, texts) == [[], [], []]
