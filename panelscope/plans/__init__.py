"""Views, reports and their SQL oracles."""
