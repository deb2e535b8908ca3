"""Knowledge-graph retrieval analytics as DataFrame operators."""
