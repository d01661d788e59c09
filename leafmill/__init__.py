"""leafmill: document processing, package auditing and fidelity checks as Spark plans."""
