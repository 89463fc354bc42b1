"""A small repository of our own: a component framework, a good and a bad component, one layering fault."""

import json

BASE = '''"""What every component must offer."""
import abc


class BasePlugin(abc.ABC):
    """Base class of components."""

    @abc.abstractmethod
    def start(self): ...

    def label(self, lang="en"):
        """Shown in menus."""
        return lang

    def _secret(self):
        return 1
'''

VIEWS = '''from flask import Blueprint

bills = Blueprint("bills", __name__, url_prefix="/admin/billing")


@bills.route("/open", methods=["POST", "GET"])
def open_bills():
    return []


@bills.delete("/<int:n>")
def drop(n):
    return n
'''

FILES = {
    "plugin_manager/base.py": BASE,
    "plugin_manager/manager.py": "from .base import BasePlugin\n\n\nclass ComponentManager:\n    def names(self):\n        return []\n",
    "plugin_manager/discovery.py": '"""How components are found.\n\nOne folder each.\n"""\n',
    "plugin_manager/util.py": "X = 1\n",
    "plugins/_base/http.py": '"""HTTP helpers."""\n# none yet\n',
    "plugins/_templates/shop/plugin.json": '{"name": "Shop template"}',
    "plugins/billing/__init__.py": (
        '"""Billing component."""\nfrom plugin_manager.base import BasePlugin\nfrom plugins.ledger import post\n'
        'from plugins._base.http import get\n\n\nclass Billing(BasePlugin):\n    """Sends bills."""\n'
    ),
    "plugins/billing/views.py": VIEWS,
    "plugins/billing/plugin.json": json.dumps({"identifier": "billing", "version": "3.1.0", "capabilities": ["bill"], "depends_on": ["ledger", "mail"], "hooks": {"b": 1, "a": 2}}),
    "plugins/billing/i18n/en.yml": "a: b\n",
    "plugins/billing/README.md": "# Billing\n",
    "plugins/ledger/__init__.py": "def post(x):\n    return x\n",
    "plugins/ledger/plugin.json": json.dumps({"identifier": "Ledger!", "version": "2"}),
    "plugins/half/__init__.py": "",
    "core/run.py": "import plugins.ledger\nimport os\n\n\ndef main():\n    return os\n",
    "main.py": '"""Entry."""\n\n\n@app.get("/up")\ndef up():\n    return 1\n',
    "docs/plugin-manifest.schema.json": json.dumps({"required": ["identifier", "version", "capabilities"], "properties": {"kind": {"enum": ["a", "b"]}, "name": {"type": "string"}}}),
    "AGENTS.md": "# Agents\n### Naming\ntext\n### Tests\n",
    "debug_me.py": "1\n",
    "out.log": "noise\n",
}
