"""Python sources around a document, and what is left without comments.

``{T}`` is the document's text without quotes, backslashes and braces, ``{S}`` its
source. A document takes the template of its id modulo their number. In the
first, second and fourth its text is code and stays, also lines that look like
comments; in the third it is a string in column 0, which goes.
"""

from __future__ import annotations

PYTHON = (
    (
        "# {S}\ndef f():\n    x = '''{T}'''  # {S}\n    return x\n",
        "def f():\n    x = '''{T}'''  \n    return x\n",
    ),
    (
        'print("""{T}""",  # {S} "\n      "#{S}")\n\n# end\n',
        'print("""{T}""",  \n      "#{S}")\n',
    ),
    (
        "y = [\n'''{T}''',\n  2]\nz = r\"a#b\"  # '''\n",
        'y = [\n,\n  2]\nz = r"a#b"  \n',
    ),
    (
        "w = f'''{T} {1}'''\nif w:\n    '''{S}'''\n    v = \"# \" + w  # end\nelse:\n    v = '#'\n",
        "w = f'''{T} {1}'''\nif w:\n    v = \"# \" + w  \nelse:\n    v = '#'\n",
    ),
)


def parts(template: str) -> list[str]:
    """The template in order: ``{T}``, ``{S}`` and the text between."""
    found = [template]
    for mark in ("{T}", "{S}"):
        found = [x for part in found for x in _cut(part, mark)]
    return [x for x in found if x]


def _cut(part: str, mark: str) -> list[str]:
    if part in ("{T}", "{S}"):
        return [part]
    pieces = part.split(mark)
    return [x for piece in pieces for x in (piece, mark)][:-1]
