"""Report catalogues and the batch pipeline, composed from the operators."""
