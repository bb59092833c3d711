"""kelpie.llm: operators for preparing text for training; nothing else in the library imports them."""
