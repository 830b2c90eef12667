"""Adapters to models that run elsewhere: chat, embedding and rerank, and what is built of them."""
