"""What counts as markup in a text: an element's name alone between angle brackets, or a name with values given to attributes."""

from __future__ import annotations

import re

#: Element names of HTML (fixed values): only these make a tag of a single word between angle brackets.
_ELEMENTS = (
    "a abbr address article aside audio b bdi bdo blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object "
    "ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody "
    "td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
#: Lower-case texts are matched.
TAG = re.compile(rf"""<(?:/?(?:{"|".join(_ELEMENTS.split())})\s*/?|[a-z][a-z0-9:-]*(?:\s+[a-z_:@][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))+\s*/?)>""")
