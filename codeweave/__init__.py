"""codeweave: code-corpus analytics as Spark DataFrame operators."""
