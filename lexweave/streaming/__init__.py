"""Status tracking on a stream: an extension of the batch operators."""
