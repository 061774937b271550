"""runloom: set-oriented analytics over AI-agent execution traces, on Spark."""
